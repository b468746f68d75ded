"""Tokens, stems, lexicons, fingerprints: fixed values and properties."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attestra.functions import identity as I
from attestra.functions import text as X
from attestra.schemas import Policy

PRINTS = {
    "The court granted the motion.": "7d762a0da23e14f3",
    "THE COURT GRANTED THE MOTION.": "7d762a0da23e14f3",
    "The court granted the motions.": "6d60d02aaf13048e",
    "Ünïcode – emoji 🧾 claim": "aa307cf8c86113c6",
    "a": "af63dc4c8601ec8c",
    "The tenant paid rent in June.": "8648614037622e2",
    "": "cbf29ce484222325",
}


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_claim_fingerprints_vectorised_and_native(spark):
    rows = spark.createDataFrame([(t,) for t in PRINTS], "t string").select("t", I.claim_fingerprint(F.col("t")).alias("a"), I.claim_fingerprint_native(F.col("t")).alias("b")).collect()
    assert {r["t"]: r["a"] for r in rows} == PRINTS == {r["t"]: r["b"] for r in rows}


def test_sql_functions(spark):
    I.register(spark)
    row = spark.sql("SELECT claim_fingerprint('The court granted the motion.') AS a, passage_fingerprint('x') AS b").first()
    assert row["a"] == "7d762a0da23e14f3" and row["b"] == hashlib.sha256(b"x").hexdigest()


@pytest.mark.parametrize(
    "policy, want",
    [
        (Policy(), "2f7f3374f9569df303c94cf3a050898e3608269a2e8c8d3aa00d56161642f3e0"),
        (Policy(supported=0.9), "5b01a467c93e6fa46cc25b4530d1ae56a9bd84087d5cbad055085f9797f1d90f"),
        (Policy(maximum_evidence=5), "c3909fdd0b5fa65e2fd1f8136766347b3636475339566e47a6d788f8d3186c24"),
        (Policy(0.72, 0.35, 0.5, 2), "15c1e861d61f397b0fdb06af37264349e0f7f3ed62c9a3420cdc38c07bb02b11"),
    ],
)
def test_policy_fingerprints(policy, want):
    assert I.policy_fingerprint(policy) == want
    assert I.policy_fingerprint(policy, verifier="other") != want


def test_policy_rejects_negative_evidence():
    with pytest.raises(ValueError):
        Policy(maximum_evidence=-1)


def test_report_fingerprints(spark):
    m = (I.fnv1a([b"the court granted the motion."])[0], "directlySupported")
    r = (I.fnv1a([b"the tenant paid rent in march."])[0], "contradicted")
    want = {
        (): "fd3d566cd022044a0cbb092fa4bcc40e766ab99dc7541828f05606451c12a3a8",
        (m,): "6e3d1fbe605503549393a962aa2938c3339620968d2f2564ab972d69f7c9f35e",
        (m, r): "d73ba74e905ce697f94aacb26936a01bd896637754112c1c8e26736022197071",
        (r, m): "c9bff33a00b9aba4a217d6b53938e5ec52eecd1d1da2b982dc9b718566000140",
    }
    for verdicts, fingerprint in want.items():
        rows = [([{"fingerprint": f"{int(h):x}", "status": s} for h, s in verdicts],)]
        df = spark.createDataFrame(rows, "v array<struct<fingerprint:string,status:string>>")
        assert df.select(I.report_fingerprint(F.col("v"))).first()[0] == fingerprint


def test_stems_and_terms(spark):
    assert one(spark, "Denied filing approved increases during the court's 3 of not", X.significant_terms) == ["deny", "fil", "approv", "increase", "dur", "court"]
    assert one(spark, "", X.significant_terms) == []


def test_values_negation_speculation(spark):
    assert one(spark, "On March 3 he paid 40b", X.structured_values) == ["march", "3", "40b"]
    assert one(spark, "It can't, didn't", X.negated) is False
    assert one(spark, "They cannot", X.negated) is True
    assert one(spark, "A proposed plan", X.speculative) is True


def test_trim_and_utf16(spark):
    assert one(spark, " \t x  \n", X.trimmed) == "x"
    assert one(spark, "a🧾b", X.utf16_length) == 4
    assert one(spark, "a🧾b", lambda t: X.utf16_slice(t, F.lit(1), F.lit(3)) == F.encode(F.lit("🧾"), "UTF-16BE")) is True
    assert one(spark, "a b/c", X.safe_file_name) == "a-b-c" and one(spark, "", X.safe_file_name) == "reviewer"
