"""The k best passages by summed weights, against brute force; joins with heavy keys."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.operators import extract, retrieve, skew, topk, verify
from attestra.plans.pipeline import Pipeline
from attestra.schemas import CLAIM_TYPES, SOURCE_TYPES

EVIDENCE = "scope string, evidence_ordinal int, id string, source string, source_type string, text string"


def zipf(rng, words, n):
    return [words[min(int(rng.paretovariate(0.6)) - 1, len(words) - 1)] for _ in range(n)]


def brute(claims, postings, k):
    of = collections.defaultdict(list)
    for scope, term, at, name, w, classes in postings:
        of[scope, term].append((at, name, w, classes))
    out = []
    for scope, doc, kind, terms in claims:
        total = collections.Counter()
        for t in terms or ():
            for at, name, w, classes in of.get((scope, t), ()):
                if kind in classes:
                    total[at, name] += w
        best = sorted(total.items(), key=lambda x: (-x[1], x[0][1], x[0][0]))[:k]
        out += [(scope, doc, at, name, w, r) for r, ((at, name), w) in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("unit", [True, False])
def test_best_equals_brute_force(spark, unit):
    for seed in range(1):
        rng = random.Random(seed)
        words = [f"w{i}" for i in range(60)]
        postings = [
            (s, t, at, f"p{rng.randrange(30)}", 1 if unit else int(2 ** rng.uniform(0, 40)), rng.choice([["a"], ["b"], ["a", "b"], []]))
            for s in ("x", "y") for at in range(70) for t in sorted(set(zipf(rng, words, rng.randint(1, 25))))
        ]
        names = {}
        postings = [(s, t, at, names.setdefault((s, at), n), w, names.setdefault((s, at, 1), c)) for s, t, at, n, w, c in postings]
        claims = [(s, i, k, sorted(set(zipf(rng, words, rng.randint(0, 12))))) for i, (s, k) in enumerate((rng.choice("xyz"), rng.choice("abc")) for _ in range(80))] + [("x", 500, "a", None), ("x", None, "a", ["w0", "w1"]), ("x", None, "a", ["w0"])]
        c = spark.createDataFrame(claims, "scope string, doc long, class string, terms array<string>").repartition(3)
        p = spark.createDataFrame(postings, "scope string, term string, evidence_ordinal int, id string, w long, classes array<string>").repartition(3)
        for k, depth in ((3, 3), (200, None)) if unit else ((1, 1), (3, None)):
            got = sorted((tuple(r) for r in topk.best(c, ["scope", "doc"], p, k, depth).select("scope", "doc", "evidence_ordinal", "id", "total", "rank").collect()), key=repr)
            assert got == brute(claims, postings, k), (seed, k, depth)
    assert topk.best(c, ["scope", "doc"], p, 0).count() == 0 and topk.best(c, ["scope", "doc"], p.limit(0), 3).count() == 0 and topk.best(c.limit(0), ["scope", "doc"], p, 3).count() == 0


def test_bm25_over_a_hundred_thousand_passages(spark):
    """The same rows as adding up all postings; only a small part of the passages is scored."""
    words = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.concat(F.lit("t"), F.floor(F.pow(F.lit(20000.0), (F.pmod(F.xxhash64("id", i), F.lit(10**6)) / 10**6))).cast("string")))
    rows = spark.range(100_000).select(F.lit("s").alias("scope"), F.col("id").cast("int").alias("evidence_ordinal"), F.concat(F.lit("p"), "id").alias("id"), F.lit("x").alias("source"), F.lit("unknown").alias("source_type"), F.concat(F.lit("the "), F.array_join(words, " ")).alias("text"))
    own = rows.filter("evidence_ordinal % 500 = 3").select("scope", F.col("evidence_ordinal").alias("doc_id"), F.lit(0).alias("ordinal"), F.concat(F.substring("text", 1, 40), F.lit(" the t1 unknown")).alias("text"))
    got = {(r["doc_id"], r["rank"]): (r["id"], r["score"]) for r in retrieve.bm25(own, rows, 5).collect()}
    asked = own.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    sums = asked.join(retrieve.weights(rows), "term").groupBy("doc_id", "id").agg(F.sum("w").alias("w"))
    want = collections.defaultdict(list)
    for r in sums.collect():
        want[r["doc_id"]].append((-r["w"], r["id"]))
    assert len(want) == 200
    for d, x in want.items():
        assert [got[d, i] for i in range(1, 6)] == [(name, -w / 2**retrieve.FRACTION) for w, name in sorted(x)[:5]]


def test_one_term_in_all_passages(spark, monkeypatch):
    """No key of a join holds over a hundredth of the rows that meet there, though each claim and passage has the term."""
    seen = []
    join = skew.split_join

    def watched(left, right, keys, *by, **kw):
        kw = {"share": 0.01, "at_least": 20}
        sides = [("l", left, by[0]), *([("r", right, by[1])] if len(by) > 1 else [])]
        found = {side: skew.pieces(rows, keys, kw["share"], 20) for side, rows, _ in sides}
        for side, rows, own in sides:
            n = rows.count()
            if n > 2000:
                dealt = rows.withColumn("piece", F.pmod(F.xxhash64(F.lit(7), own), skew._looked_up(found[side], F.xxhash64(*keys))))
                seen.append((rows.groupBy(*keys).count().agg(F.max("count")).first()[0] / n, dealt.groupBy(*keys, "piece").count().agg(F.max("count")).first()[0] / n))
        return join(left, right, keys, *by, **kw)

    monkeypatch.setattr(topk, "split_join", watched)
    rng = random.Random(3)
    passages = [("s", i, f"p{i:05}", "x", rng.choice(SOURCE_TYPES), "court " + " ".join(f"word{rng.randrange(3000)}" for _ in range(4))) for i in range(3000)]
    claims = [("s", i, 0, f"court word{rng.randrange(3000)} word{rng.randrange(3000)} nothing{i}", rng.choice(CLAIM_TYPES)) for i in range(2500)]
    e = spark.createDataFrame(passages, EVIDENCE)
    c = spark.createDataFrame(claims, "scope string, doc_id long, ordinal int, text string, type string")
    got = {}
    for r in verify.best_matches(c, e, 3).collect():
        got.setdefault(r["doc_id"], {})[r["rank"]] = (r["id"], r["score"])
    allowed = {(c, s) for c in CLAIM_TYPES for s in SOURCE_TYPES if s == "unknown" or s in verify.ELIGIBLE[c]}
    theirs = [(p[2], p[4], set(p[5].split())) for p in passages]
    for _, i, _, text, kind in claims[::25]:
        own = set(text.split())
        best = sorted((-len(own & t) / len(own), name) for name, s, t in theirs if (kind, s) in allowed and kind not in verify.NOT_VERIFIABLE and own & t)[:3]
        assert got.get(i, {}) == {r: (name, -score) for r, (score, name) in enumerate(best, 1)}
    assert seen and max(before for before, _ in seen) > 0.05 and all(after < 0.01 for _, after in seen)


def test_split_join_is_the_join(spark):
    left = spark.range(3000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit("warm")).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    right = spark.range(900).select(F.col("id").alias("b"), F.when(F.col("id") % 10 == 0, F.lit("warm")).when(F.col("id") % 10 == 1, F.lit("hot")).otherwise((F.col("id") % 70).cast("string")).alias("k"))
    rows = lambda df: sorted(tuple(r) for r in df.select("a", "b", "k").collect())
    assert skew.pieces(left, ["k"], 0.05).keys() and rows(skew.split_join(left, right, ["k"], "a", "b", 0.02, 10)) == rows(left.join(right, "k"))
    assert rows(skew.split_join(left.limit(0), right, ["k"], "a", "b", 0.02, 10)) == []


def test_candidates_are_scored_in_place_and_extraction_runs_once(spark):
    docs = spark.createDataFrame([(f"d{i}", "The court granted the motion. The clerk lost the whole file.") for i in range(3)], "doc_id string, text string")
    e = spark.createDataFrame([(f"d{i}", j, f"p{j}", "src", "unknown", t) for i in range(3) for j, t in enumerate(["The court granted the motion.", "Rent was paid.", "The clerk lost a file."])], EVIDENCE)
    calls = []

    def counted(documents):
        calls.append(1)
        return extract.claims(documents.withColumn("text", F.when(F.raise_error(F.lit("extracted again")) if len(calls) > 1 else F.lit(True), F.col("text"))))

    out = Pipeline(extractor=counted).verdicts(docs, e)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(calls) == 1 and "regexp_extract_all" in plan and "posexplode" not in plan and plan.count("Generate") == 0
    assert "array_intersect" in plan and len(out.collect()) == 6
    wide = {(r["doc_id"], r["ordinal"]): (r["status"], [x["id"] for x in r["evidence"]]) for r in Pipeline(retriever=None).verdicts(docs, e).collect()}
    assert wide == {(r["doc_id"], r["ordinal"]): (r["status"], [x["id"] for x in r["evidence"]]) for r in out.collect()}
