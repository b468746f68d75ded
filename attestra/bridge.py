"""JSON requests to JSON responses, a table at a time; a bad request is an answer, not a failure."""

from __future__ import annotations

import calendar
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import render
from attestra.functions import identity as I
from attestra.operators import extract, provenance, report, verify
from attestra.schemas import REQUEST, SOURCE_TYPES, Policy

UUID = r"(?i)\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"


def parsed(requests: DataFrame) -> DataFrame:
    """request_id, r (the request) and problem (null: it can be run).  runID counts only if provenance is asked for."""
    r = F.col("r")
    rows = requests.withColumn("r", F.from_json("request", REQUEST, {"mode": "PERMISSIVE"}))
    bad_source = F.exists(r["evidence"], lambda e: e["sourceType"].isNotNull() & ~e["sourceType"].isin(*SOURCE_TYPES))
    short = F.exists(r["evidence"], lambda e: e["id"].isNull() | e["source"].isNull() | e["text"].isNull())
    problem = (
        F.when(r.isNull() | r["document"].isNull() | r["evidence"].isNull() | F.coalesce(short, F.lit(False)), "the request is not a JSON object with document and evidence")
        .when(bad_source, "an evidence passage has an unknown sourceType")
        .when(r["policy"]["maximumEvidenceMatches"] < 0, F.concat(F.lit("maximumEvidenceMatches must be non-negative: "), r["policy"]["maximumEvidenceMatches"].cast("string")))
        .when(r["includeProvenance"] & r["runID"].isNotNull() & ~r["runID"].rlike(UUID), F.concat(F.lit("runID is not a valid UUID: "), r["runID"]))
    )
    return rows.select("request_id", "r", problem.alias("problem"))


def _error(code: str, message: Column) -> Column:
    return F.to_json(F.struct(F.struct(F.lit(code).alias("code"), message.alias("message")).alias("error")))


def _policy(p: Column) -> Column:
    """The request's policy, with the defaults for what it leaves out."""
    d = Policy()
    fields = (("supported", p["supportedThreshold"], d.supported), ("ambiguous", p["ambiguousThreshold"], d.ambiguous), ("contradiction", p["contradictionThreshold"], d.contradiction), ("maximum_evidence", p["maximumEvidenceMatches"], d.maximum_evidence))
    return F.struct(*[F.coalesce(x, F.lit(v)).alias(k) for k, x, v in fields])


def respond(requests: DataFrame) -> DataFrame:
    """request_id, response (JSON) of each row of request_id, request (JSON); each under its own policy, all in one plan."""
    rows = parsed(requests)
    out = rows.filter("problem is not null").select("request_id", _error("invalidRequest", F.col("problem")).alias("response"))
    return out.unionByName(_respond(rows.filter("problem is null").withColumn("policy", _policy(F.col("r.policy")))))


def _respond(good: DataFrame) -> DataFrame:
    docs = good.select(F.col("request_id").alias("doc_id"), F.col("r.document").alias("text"))
    e = good.select(F.col("request_id").alias("scope"), F.posexplode("r.evidence").alias("evidence_ordinal", "e"))
    evidence = e.select("scope", "evidence_ordinal", "e.id", "e.source", F.coalesce("e.sourceType", F.lit("unknown")).alias("source_type"), "e.text")
    p = F.col("policy")
    fingerprint = I.policy_fingerprints(p["supported"], p["ambiguous"], p["contradiction"], p["maximum_evidence"])
    asked = good.select(F.col("request_id").alias("doc_id"), "policy", fingerprint.alias("policy_fingerprint"), F.coalesce("r.includeMarkdown", F.lit(False)).alias("markdown"), F.coalesce("r.includeProvenance", F.lit(False)).alias("trace"), F.coalesce("r.runID", F.uuid()).alias("run_id"), I.iso_utc(F.current_timestamp()).alias("now"))
    most = good.agg(F.max("policy.maximum_evidence")).first()[0] or 0
    claims = extract.claims(docs).withColumn("scope", F.col("doc_id")).join(asked.select("doc_id", "policy"), "doc_id")
    v = verify.verdicts(claims, evidence, verify.PolicyColumns(p["supported"], p["ambiguous"], p["contradiction"], p["maximum_evidence"], most)).drop("policy")
    reports = report.reports(v, docs).join(asked.select("doc_id", "policy_fingerprint"), "doc_id")
    events = provenance.events(v, reports, F.col("policy_fingerprint"))
    runs = provenance.runs(events)
    edges = provenance.edges(v, reports).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("target_sequence", "source_sequence", "type"))).alias("edges"))
    events = events.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "type", "priority", "payload"))).alias("events")).join(runs, "doc_id").join(edges, "doc_id", "left")
    shown = F.struct("ordinal", "claim_id", "text", "type", "parent_text", "fingerprint", "status", "confidence", "explanation", "evidence")
    listed = v.groupBy("doc_id").agg(F.array_sort(F.collect_list(shown)).alias("verdicts"))
    joined = reports.join(listed, "doc_id", "left").join(events, "doc_id", "left").join(asked.drop("policy", "policy_fingerprint"), "doc_id")
    packed = joined.select(F.col("doc_id").alias("request_id"), F.to_json(F.struct("verdicts", "events", "edges", "run_fingerprint", "blocking_ids", "review_ids", "disposition", "report_fingerprint", "policy_fingerprint", "markdown", "trace", "run_id", "now")).alias("all"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for batch in batches:
            yield pd.DataFrame({"request_id": batch["request_id"], "response": [response(json.loads(x)) for x in batch["all"]]})

    return packed.mapInPandas(run, f"request_id {requests_type(good)}, response string")


def requests_type(rows: DataFrame) -> str:
    return rows.schema["request_id"].dataType.simpleString()


def response(row: dict) -> str:
    """A response with sorted keys; what is absent is left out."""
    import json

    def whole(x: float) -> float | int:
        return int(x) if float(x).is_integer() else x

    verdicts = row.get("verdicts") or []
    claim = lambda v: {"id": v["claim_id"], "text": v["text"], "type": v["type"], "fingerprint": v["fingerprint"]} | ({"parentText": v["parent_text"]} if v.get("parent_text") else {})
    match = lambda e: {"passage": {"id": e["id"], "source": e["source"], "sourceType": e["source_type"], "text": e["text"]}, "score": whole(e["score"]), "matchedTerms": e["matched_terms"]}
    out = {
        "specVersion": I.SPEC_VERSION,
        "report": {"version": 1, "createdAt": row["now"], "verdicts": [{"claim": claim(v), "status": v["status"], "confidence": whole(v["confidence"]), "explanation": v["explanation"], "evidence": [match(e) for e in v["evidence"]]} for v in verdicts]},
        "decision": {"disposition": row["disposition"], "blockingClaimIDs": row["blocking_ids"], "reviewClaimIDs": row["review_ids"]},
        "reportFingerprint": row["report_fingerprint"],
        "policyFingerprint": row["policy_fingerprint"],
    }
    if row["markdown"]:
        out["markdown"] = render.proof_report(verdicts)
    if row["trace"]:
        out["provenanceManifest"] = json.dumps(manifest(row), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return json.dumps(out, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def manifest(row: dict) -> dict:
    """The same shape as ``provenance.manifests`` writes, for one response; event ids follow from the run and the sequence."""
    created = int(calendar.timegm(time.strptime(row["now"], "%Y-%m-%dT%H:%M:%SZ"))) - provenance.REFERENCE_DATE
    ids = {e["sequence"]: str(uuid.uuid5(uuid.UUID(row["run_id"]), str(e["sequence"]))).upper() for e in row["events"]}
    envelope = lambda e: {"id": ids[e["sequence"]], "runID": row["run_id"].upper(), "contextID": I.CONTEXT, "engineName": I.ENGINE, "schemaVersion": I.SCHEMA_VERSION, "sequence": e["sequence"], "timestamp": created, "payload": {"typeIdentifier": e["type"], "priorityValue": e["priority"], "rawJSON": e["payload"]}}
    return {
        "bridgeVersion": provenance.BRIDGE_VERSION, "specVersion": I.SPEC_VERSION, "engineName": I.ENGINE, "contextID": I.CONTEXT, "runFingerprint": row["run_fingerprint"], "reportFingerprint": row["report_fingerprint"], "policyFingerprint": row["policy_fingerprint"],
        "events": [envelope(e) for e in row["events"]], "edges": [{"sourceID": ids[e["source_sequence"]], "targetID": ids[e["target_sequence"]], "type": e["type"]} for e in row.get("edges") or []],
    }
