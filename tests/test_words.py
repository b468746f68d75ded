"""Claims cut into terms in Arrow batches: the terms of the Column expressions, and each claim scored once."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.functions import words as W
from attestra.operators import extract, retrieve, verify
from tests.test_few import made

PARTS = ["Court", "granted", "DENIED", "running", "sing", "bed", "bus", "the", "a", "x", "İstanbul", "Straße", "ÉLAN", "e\u0301t\u00e9s", "\u0301x", "٣٤", "no4not", "Ⅻs", "½", "Ⓐed", "字字", "2,5", "a_b", "don't", "\u2028", "\x00", "😀s", "ing", "ed"]


def texts():
    rng = random.Random(3)
    return ["", None, "...", "word", *["".join(rng.choice(PARTS) + rng.choice([" ", "", "-", ". ", "\n", "\u00a0"]) for _ in range(rng.randrange(12))) for _ in range(400)]]


def test_terms_equal_the_expressions(spark):
    own = texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "i int, t string").select("i", X.spelled(F.col("t")).alias("s"), X.significant_terms(F.col("t")).alias("terms"), F.array_distinct(X.tokens(F.col("t"))).alias("tokens")).orderBy("i").collect()
    spelled = pa.array([r["s"] for r in rows], pa.string())
    for stem, name in ((W.significant, "terms"), (None, "tokens")):
        every = sorted({t for r in rows for t in r[name] or []})
        known = {t: i for i, t in enumerate(every[::2])}
        # a slice too: its bytes do not start where the buffer does
        for lo in (0, 57):
            text, term, sizes = W.distinct_terms(spelled.slice(lo), known, stem)
            got = [set() for _ in rows[lo:]]
            for i, t in zip(text.tolist(), term.tolist(), strict=True):
                got[i].add(every[::2][t])
            assert got == [set(r[name] or []) & known.keys() for r in rows[lo:]]
            assert sizes.tolist() == [len(r[name] or []) for r in rows[lo:]]


def test_claims_are_scored_once(spark):
    """Before, a filter on the matches had the function of the matches evaluated below it as well."""
    c, e = made(spark)
    for out in (verify.best_matches(c, e, 3), retrieve.bm25(c, e, 3)):
        assert out._jdf.queryExecution().executedPlan().toString().count("best(") == 1


def test_first_claims_equal_all_claims(spark, monkeypatch):
    rng = random.Random(8)
    ends = [". ", "! ", "?", "\n", "\r\n", "", "...", ".\n"]
    own = [None, "", *["".join(" ".join(rng.choice(["court", "and", "but", "the motion", "é", "😀", "please note"]) for _ in range(rng.randrange(1, 9))) + rng.choice(ends) for _ in range(rng.randrange(8))) for _ in range(400)]]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = rows(extract.claims(docs).filter("ordinal = 0"))
    assert len(want) > 150
    # a small head: most texts go on behind it, and some claims end right before or behind its end
    for head in (20, 41, 512):
        monkeypatch.setattr(extract, "HEAD", head)
        assert rows(extract.first_claims(docs)) == want


def test_matched_terms_are_computed_once(spark):
    from attestra import queries

    plan = queries.queries()["matched_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("array_intersect", plan)) == 1


def test_fingerprints_of_a_slice_of_a_batch():
    """Bytes are taken from the batch as they lie, with nulls and empty texts in it."""
    from attestra.functions import identity

    own = ["cut off", "", None, "the court granted the motion.", "é😀", "x" * 300]
    data, offsets = W.bytes_of(pa.array(own, pa.string()).slice(1))
    assert identity.fnv1a_of(data, offsets).tolist() == identity.fnv1a([(t or "").encode() for t in own[1:]]).tolist()
    assert f"{int(identity.fnv1a([b''])[0]):x}" == f"{identity.FNV_OFFSET:x}"
