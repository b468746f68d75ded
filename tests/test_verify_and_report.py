"""Verdicts, retrieval, reports, provenance."""

import json
import math

import pytest
from pyspark.sql import functions as F

from attestra.operators import extract, provenance, report, retrieve, verify
from attestra.plans.pipeline import Pipeline, row_verifier
from attestra.schemas import Policy

CLAIM = "scope string, doc_id string, ordinal int, claim_id string, text string, type string, fingerprint string"
EVIDENCE = "scope string, evidence_ordinal int, id string, source string, source_type string, text string"
RULE = "A response must be filed within 14 days after service of the motion."
DENIED = "The court denied the request for an extension."
CASES = [
    (RULE, "legalRule", RULE, "courtRule", "directlySupported"),
    ("The court did not deny the request for an extension.", "factual", DENIED, "courtRecord", "contradicted"),
    ("The plaintiff filed a second amended complaint.", "factual", DENIED, "courtRecord", "unsupported"),
    ("The landlord returned the deposit after inspection.", "factual", "The landlord completed the inspection and returned the keys.", "evidence", "partiallySupported"),
    ("We recommend filing a motion to compel discovery.", "recommendation", DENIED, "courtRecord", "notVerifiable"),
    (RULE, "legalRule", RULE, "courtRecord", "unsupported"),
    ("The city approved the zoning variance.", "factual", "The city is considering a proposed zoning variance.", "evidence", "unsupported"),
    ("The response deadline is 14 days.", "factual", "The response deadline is 30 days.", "unknown", "contradicted"),
]


def claim(spark, *texts, kind="factual", scope="s"):
    return spark.createDataFrame([(scope, "d", i, f"c{i}", t, kind, f"f{i}") for i, t in enumerate(texts)], CLAIM)


def passages(spark, *texts, kind="unknown", scope="s"):
    return spark.createDataFrame([(scope, i, f"p{i}", "src", kind, t) for i, t in enumerate(texts)], EVIDENCE)


def test_verdict_ladder(spark):
    claims = spark.createDataFrame([(str(i), str(i), 0, "c", c, k, "f") for i, (c, k, *_) in enumerate(CASES)], CLAIM)
    evidence = spark.createDataFrame([(str(i), 0, "p", "src", s, p) for i, (_, _, p, s, _) in enumerate(CASES)], EVIDENCE)
    got = {int(r["doc_id"]): r for r in verify.verdicts(claims, evidence).collect()}
    assert [got[i]["status"] for i in range(len(CASES))] == [c[-1] for c in CASES]
    assert got[4]["confidence"] == 1 and got[4]["evidence"] == []
    assert got[3]["evidence"][0]["matched_terms"] == sorted(got[3]["evidence"][0]["matched_terms"])


def test_ranks_ties_and_limits(spark):
    c = claim(spark, "alpha beta gamma delta")
    e = spark.createDataFrame([("s", i, p, "src", "unknown", t) for i, (p, t) in enumerate([("b", "alpha beta"), ("a", "alpha beta"), ("c", "alpha"), ("a", "beta alpha")])], EVIDENCE)
    shown = verify.verdicts(c, e).first()["evidence"]
    assert [(x["id"], x["score"], x["text"]) for x in shown] == [("a", 0.5, "alpha beta"), ("a", 0.5, "beta alpha"), ("b", 0.5, "alpha beta")]
    none = verify.verdicts(c, e, Policy(maximum_evidence=0)).first()
    assert none["evidence"] == [] and none["status"] == "partiallySupported"


def test_scopes_do_not_mix(spark):
    both = passages(spark, "alpha beta gamma delta", scope="other")
    row = verify.verdicts(claim(spark, "alpha beta gamma delta"), both).first()
    assert (row["status"], row["confidence"]) == ("unsupported", 1.0)


def test_bm25(spark):
    c = claim(spark, "notice of default", "zzz")
    e = passages(spark, "notice of default was mailed", "default", "of of of", "nothing here")
    rows = retrieve.bm25(c, e, 3).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["p0", "p2", "p1"] and all(r["ordinal"] == 0 for r in rows)
    n, df, length, mean = 4, {"notice": 1, "of": 2, "default": 2}, 5, (5 + 1 + 3 + 2) / 4
    want = sum(math.log((n - d + 0.5) / (d + 0.5) + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean)) for d in df.values())
    assert rows[0]["score"] == pytest.approx(want, abs=1e-9)
    assert retrieve.bm25(c, e, 0).count() == 0 and retrieve.bm25(c, e.limit(0), 3).count() == 0
    assert retrieve.clamped(-1, 2) == (0.0, 1.0) and retrieve.clamped(float("nan"), float("nan")) == (1.2, 0.75)


def test_bm25_ties_go_by_id(spark):
    e = spark.createDataFrame([("s", 0, "b", "x", "unknown", "alpha"), ("s", 1, "a", "x", "unknown", "alpha")], EVIDENCE)
    assert [r["id"] for r in retrieve.bm25(claim(spark, "alpha"), e, 2).orderBy("rank").collect()] == ["a", "b"]


def documents(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_reports_and_decisions(spark):
    docs = documents(spark, "The court granted the motion. The clerk lost the whole file.", "", "The court granted the motion.")
    evidence = passages(spark, "The court granted the motion.", scope="x")
    claims = extract.claims(docs).withColumn("scope", F.lit("x"))
    rows = {r["doc_id"]: r for r in report.reports(verify.verdicts(claims, evidence), docs).collect()}
    assert rows["d0"]["disposition"] == "block" and rows["d0"]["support_rate"] == 0.5 and not rows["d0"]["safe_to_publish"]
    assert rows["d1"]["disposition"] == "allow" and not rows["d1"]["safe_to_publish"] and rows["d1"]["support_rate"] == 0
    assert rows["d1"]["report_fingerprint"] == "fd3d566cd022044a0cbb092fa4bcc40e766ab99dc7541828f05606451c12a3a8"
    assert rows["d2"]["disposition"] == "allow" and rows["d2"]["safe_to_publish"]
    assert rows["d0"]["status_counts"] == {"directlySupported": 1, "unsupported": 1}


def test_signals(spark):
    docs = documents(spark, "The clerk lost the whole file.")
    claims = extract.claims(docs).withColumn("scope", F.lit("x"))
    s = report.signals(report.reports(verify.verdicts(claims, passages(spark, "x", scope="x")), docs))
    got = json.loads(report.signal_json(s).first()["json"])
    assert got["disposition"] == "block" and "runID" not in got and s.first()["issue"] is None
    bad = {"version": F.lit(0), "reportFingerprint": F.lit(""), "supportedClaimCount": F.lit(9), "blockingClaimIDs": F.array(F.lit("")), "runID": F.lit("")}
    for name, value in bad.items():
        assert s.withColumn(name, value).withColumn("issue", report.signal_issue()).first()["issue"], name


def test_provenance(spark):
    docs = documents(spark, 'The "court" granted a/b motion.', "")
    claims = extract.claims(docs).withColumn("scope", F.lit("x"))
    v = verify.verdicts(claims, passages(spark, 'The "court" granted a/b motion.', scope="x"))
    r = report.reports(v, docs)
    events = provenance.events(v, r)
    rows = events.filter("doc_id = 'd0'").orderBy("sequence").collect()
    assert [x["type"] for x in rows] == ["cpk_claim_extracted", "cpk_claim_verified", "cpk_report_finalized"]
    assert '"text":"The \\"court\\" granted a\\/b motion."' in rows[0]["payload"] and '"confidence":1,' in rows[1]["payload"]
    assert all(json.loads(x["payload"]) for x in rows)
    edges = provenance.edges(v, r)
    assert sorted((e["source_sequence"], e["target_sequence"], e["type"]) for e in edges.collect()) == [(0, 1, "verifiedBy"), (1, 2, "derivedFrom")]
    named = provenance.with_ids(events).cache()
    assert provenance.resolved(edges, named).count() == 2
    assert {x["doc_id"]: x["n_events"] for x in provenance.runs(events).collect()} == {"d0": 3, "d1": 1}


def test_pipeline_with_a_custom_verifier(spark):
    docs = documents(spark, "The court granted the motion. The clerk lost the whole file.")
    evidence = passages(spark, "The court granted the motion.", scope="d0")
    verdicts, reports = Pipeline(retriever=retrieve.bm25, evidence_limit=1).run(docs, evidence)
    assert reports.first()["n_supported"] == 1
    custom = row_verifier(lambda c, ps: ("directlySupported" if len(ps) else "unsupported", 2.0, "counted"))
    verdicts, reports = Pipeline(verifier=custom).run(docs, evidence)
    assert [r["confidence"] for r in verdicts.collect()] == [1.0, 1.0] and reports.first()["safe_to_publish"]


def test_payloads_of_any_type(spark):
    from pyspark.sql import Row

    df = spark.createDataFrame([Row(doc_id="d", sequence=0, payload=Row(z=1.0, b=0.25, a='x/"\n', none=None, xs=[Row(k="é", n=2)], m={"q": True, "p": False}))], "doc_id string, sequence int, payload struct<z:double,b:double,a:string,none:string,xs:array<struct<k:string,n:int>>,m:map<string,boolean>>")
    row = provenance.custom_events(df, "payload", "mine", "telemetry").first()
    assert (row["type"], row["priority"], row["payload"]) == ("mine", 0, '{"a":"x\\/\\"\\n","b":0.25,"m":{"p":false,"q":true},"xs":[{"k":"é","n":2}],"z":1}')
    with pytest.raises(KeyError):
        provenance.custom_events(df, "payload", "mine", "urgent")
