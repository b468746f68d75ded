"""Whole runs against fixed values: a traced run, and a published benchmark corpus where its file is given.

ATTESTRA_BENCHMARK names the corpus' JSON file; without it that test is skipped.
ATTESTRA_ENGINE names the engine that the fixed fingerprint of the run is over; without it
the fingerprint is held against this library's own engine name.
"""

import hashlib
import json
import os

import pytest

from attestra.functions import identity as I
from attestra.operators import benchmark as B
from attestra.operators import provenance
from attestra.plans.pipeline import Pipeline
from attestra.sources import json as J

# Texts, fingerprints and payloads that any implementation must give.
DOCUMENT = "The court denied the request for an extension. The tenant paid rent on March 1. The court granted the motion for sanctions. The mediator scheduled a conference."
EVIDENCE = [
    ("order-1", "Scheduling Order", "courtRecord", "The court denied the request for an extension."),
    ("ledger-1", "Rent Ledger", "evidence", "The tenant paid rent on March 1."),
    ("conf-1", "Case Notes", "evidence", "The mediator canceled the conference."),
]
CLAIMS = [
    ("claim-0-0", "5d9439c35f5b1eeb", 1, "2e68a13fb1abff5c3428dc8e1702a39630a25bbb27adef8774cb16eb29455a0b", "directlySupported", "The court denied the request for an extension."),
    ("claim-46-0", "69e49e925cb77800", 1, "81d68c5dff701499eca0709b6678be909e5979497e0831a8b56762c36003194c", "directlySupported", "The tenant paid rent on March 1."),
    ("claim-79-0", "31193b803adc5a64", 0.75, "2e68a13fb1abff5c3428dc8e1702a39630a25bbb27adef8774cb16eb29455a0b", "unsupported", "The court granted the motion for sanctions."),
    ("claim-123-0", "3ae263215eb0133d", 0.6666666666666666, "8f0759e66fc5fe3fe05599b7c017fd86b4bc57c0a48b28879394d76b097d1d15", "partiallySupported", "The mediator scheduled a conference."),
]
POLICY = "2f7f3374f9569df303c94cf3a050898e3608269a2e8c8d3aa00d56161642f3e0"
REPORT = "88084406da17ab7b21b4713462dbfdcbe48c1f40cfa00d17a402e7881924cc53"
RUN = "ec18108308e73e6b5591f1810989075ee97d25f5"


def test_traced_run(spark):
    documents = spark.createDataFrame([("d", DOCUMENT)], "doc_id string, text string")
    evidence = spark.createDataFrame([("d", i, *e) for i, e in enumerate(EVIDENCE)], "scope string, evidence_ordinal int, id string, source string, source_type string, text string")
    verdicts, reports = (x.cache() for x in Pipeline().run(documents, evidence))
    events = provenance.events(verdicts, reports).orderBy("sequence").collect()
    compact = lambda x: json.dumps(x, separators=(",", ":"))
    want = []
    for claim, fingerprint, confidence, passage, status, text in CLAIMS:
        want.append((2, "cpk_claim_extracted", compact({"claimID": claim, "claimType": "factual", "fingerprint": fingerprint, "text": text})))
        want.append((3, "cpk_claim_verified", compact({"claimFingerprint": fingerprint, "confidence": confidence, "evidenceFingerprints": [passage], "status": status})))
    assert [(e["priority"], e["type"], e["payload"]) for e in events[:-1]] == want
    last = json.loads(events[-1]["payload"])
    assert (events[-1]["priority"], events[-1]["type"], events[-1]["sequence"]) == (3, "cpk_report_finalized", 8)
    assert (last["policyFingerprint"], last["reportFingerprint"], last["safeToPublish"], last["specVersion"]) == (POLICY, REPORT, False, "1.0")
    assert last["statusCounts"] == {"directlySupported": 2, "partiallySupported": 1, "unsupported": 1}
    edges = {(r["source_sequence"], r["target_sequence"], r["type"]) for r in provenance.edges(verdicts, reports).collect()}
    assert edges == {x for i in range(0, 8, 2) for x in ((i, i + 1, "verifiedBy"), (i + 1, 8, "derivedFrom"))}
    engine = os.environ.get("ATTESTRA_ENGINE")
    run = provenance.runs(provenance.events(verdicts, reports), engine or I.ENGINE).first()
    signature = "".join(f"{e['type']}:{I.ENGINE}|" for e in events)
    assert run["n_events"] == 9 and run["run_fingerprint"] == (RUN if engine else hashlib.sha1(signature.encode()).hexdigest())


@pytest.mark.skipif("ATTESTRA_BENCHMARK" not in os.environ, reason="ATTESTRA_BENCHMARK names no corpus")
def test_published_benchmark(spark):
    head, cases, extraction = J.corpus(spark, os.environ["ATTESTRA_BENCHMARK"])
    r = B.run(head["version"], head["name"], head["metadata"], cases, extraction)
    m, x = r.m, r.extraction
    assert (m["n_exact"], m["n_cases"], x["n_cases"], m["n_dangerous"]) == (28, 34, 10, 0)
    assert (m["n_unsafe"], m["n_approval"]) == (24, 10)
    shown = ("verdict_accuracy", "false_supported_rate", "contradiction_recall", "supported_precision", "unsupported_recall", "warning_precision", "abstention_precision", "abstention_recall", "upper_bound", "approval_recall")
    assert [round(100 * m[k], 1) for k in shown] == [82.4, 0.0, 100.0, 100.0, 100.0, 92.3, 100.0, 100.0, 11.7, 80.0]
    assert (x["precision"], x["recall"], round(r.calibration_error, 3)) == (1.0, 1.0, 0.061)
    bins = [(b["n_cases"], round(b["mean_confidence"], 2), round(100 * b["exact_rate"], 1)) for b in r.bins if b["n_cases"]]
    assert bins == [(4, 0.46, 25.0), (13, 0.69, 76.9), (17, 0.99, 100.0)]
    assert {k: (c["n_exact"], c["n_cases"]) for k, c in r.categories.items()} == {
        "citationIntegrity": (2, 3), "contradiction": (8, 8), "directSupport": (8, 8), "notVerifiable": (2, 2),
        "partialSupport": (3, 4), "reasonableInference": (0, 2), "sourceAuthority": (3, 3), "unsupported": (2, 4),
    }
    assert [(w["id"], w["expected"], w["predicted"]) for w in r.mismatches] == [
        ("inference-001", "supportedByInference", "partiallySupported"), ("inference-002", "supportedByInference", "partiallySupported"), ("partial-002", "partiallySupported", "contradicted"),
        ("unsupported-003", "unsupported", "partiallySupported"), ("unsupported-004", "unsupported", "partiallySupported"), ("citation-003", "unsupported", "partiallySupported"),
    ]
