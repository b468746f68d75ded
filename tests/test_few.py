"""Small evidence: the same rows as the lists of ``topk``, with nothing joined, shuffled or aggregated."""

import random

from pyspark.sql import functions as F

from attestra.operators import few, retrieve, topk, verify
from attestra.schemas import CLAIM_TYPES, SOURCE_TYPES, Policy

EVIDENCE = "scope string, evidence_ordinal int, id string, source string, source_type string, text string"
CLAIM = "scope string, doc_id long, ordinal int, text string, type string"


def made(spark, seed=5):
    rng = random.Random(seed)
    words = ["court", "granted", "not", "March", "Élan", *[f"word{i}" for i in range(40)]]
    said = lambda n: " ".join(words[min(int(rng.paretovariate(0.5)) - 1, len(words) - 1)] for _ in range(n))
    # ids repeat, so that ties go to the place; one scope has no evidence
    passages = [(s, i, f"p{rng.randrange(20)}", "src", rng.choice(SOURCE_TYPES), said(rng.randrange(0, 15))) for s in "xy" for i in range(40)]
    claims = [(rng.choice("xyz"), i, 0, said(rng.randrange(0, 12)), rng.choice(CLAIM_TYPES)) for i in range(300)]
    return spark.createDataFrame(claims, CLAIM), spark.createDataFrame(passages, EVIDENCE)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_small_evidence_equals_the_lists(spark, monkeypatch):
    c, e = made(spark)
    few_rows = {k: (rows(verify.best_matches(c, e, k).select("doc_id", "evidence_ordinal", "id", "score", "rank")), rows(retrieve.bm25(c, e, k).select("doc_id", "evidence_ordinal", "id", "score", "rank"))) for k in (1, 3, 20)}
    told = rows(verify.verdicts(c, e, Policy(maximum_evidence=2)))
    monkeypatch.setattr(few, "PASSAGES", 0)
    for k, (matches, found) in few_rows.items():
        assert matches and matches == rows(verify.best_matches(c, e, k).select("doc_id", "evidence_ordinal", "id", "score", "rank"))
        assert found and found == rows(retrieve.bm25(c, e, k).select("doc_id", "evidence_ordinal", "id", "score", "rank"))
    assert told == rows(verify.verdicts(c, e, Policy(maximum_evidence=2)))


def test_claims_are_not_shuffled(spark, monkeypatch):
    """The evidence may be; the claims meet it where they stand (before: joins and aggregates of claim-term rows)."""
    c, e = made(spark)
    monkeypatch.setattr(topk, "best", lambda *a: (_ for _ in ()).throw(AssertionError("lists for small evidence")))
    for out in (verify.verdicts(c, e), verify.best_matches(c, e, 3), retrieve.bm25(c, e, 3)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        claims_side = [line for line in plan.splitlines() if "Aggregate" in line and "doc_id" in line]
        assert not claims_side and "Window" not in plan
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_repeated_and_null_keys_are_claims_of_their_own(spark):
    _, e = made(spark)
    c = spark.createDataFrame([("x", None, 0, "court granted word1", "factual"), ("x", 7, 0, "court granted word1", "factual"), ("x", 7, 0, "nothing", "factual")], CLAIM)
    got = {(r["doc_id"], r["text"]): len(r["evidence"]) for r in verify.verdicts(c, e).collect()}
    assert got == {(None, "court granted word1"): 3, (7, "court granted word1"): 3, (7, "nothing"): 0}
    assert not few.fits(e.withColumn("text", F.repeat(F.lit("x "), few.BYTES)))
