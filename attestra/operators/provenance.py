"""Provenance of reports: events, edges, payloads and run fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions import identity as I
from attestra.operators import report
from attestra.schemas import Policy

# Priorities, edge types, the manifest's version, and what each payload's canonical text looks like.
PRIORITIES = {"telemetry": 0, "diagnostic": 1, "structural": 2, "critical": 3}
PRIORITY = {I.EXTRACTED: PRIORITIES["structural"], I.VERIFIED: PRIORITIES["critical"], I.FINALIZED: PRIORITIES["critical"]}
BRIDGE_VERSION = "1.0"
#: Seconds from 1970 to the reference date of timestamps, 2001-01-01; these are whole seconds.
REFERENCE_DATE = 978307200
#: Strings of which JSON escapes nothing: visible ASCII and blanks but quotes, slashes and backslashes.
PLAIN = r"^[ !#-.0-\[\]-~]*\z"
EDGE_TYPES = ("derivedFrom", "influencedBy", "generatedFrom", "verifiedBy", "correctedBy", "informed")


def json_string(x: Column) -> Column:
    """A JSON string literal with / escaped, as canonical payloads have it."""
    x = F.coalesce(x, F.lit(""))
    whole = F.to_json(F.struct(x.alias("x")))  # {"x":...}
    quoted = F.substr(whole, F.lit(6), F.length(whole) - 6)
    return F.when(x.rlike(PLAIN), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.replace(quoted, F.lit("/"), F.lit("\\/")))


def json_number(x: Column) -> Column:
    """A double as canonical payloads have it: whole numbers without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def json_strings(xs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(xs, json_string), ","), F.lit("]"))


def canonical_json(x: Column, kind: T.DataType) -> Column:
    """A value of any type as canonical payloads have it: keys in order, absent fields left out, / escaped."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        own = [F.when(x[f.name].isNotNull(), F.concat(json_string(F.lit(f.name)), F.lit(":"), canonical_json(x[f.name], f.dataType))) for f in fields]
        return F.concat(F.lit("{"), F.concat_ws(",", *own), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: F.coalesce(canonical_json(e, kind.elementType), F.lit("null"))), ","), F.lit("]"))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical_json(e["value"], kind.valueType).alias("v"))))
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return json_number(x)
    if isinstance(kind, (T.IntegralType, T.BooleanType, T.DecimalType)):
        return x.cast("string")
    return json_string(x.cast("string"))


def erased(payload: Column, kind: T.DataType, type_identifier: str, priority: str) -> Column:
    """struct(typeIdentifier, priorityValue, rawJSON): any payload as an event's, so that hosts can add events of their own types."""
    return F.struct(F.lit(type_identifier).alias("typeIdentifier"), F.lit(PRIORITIES[priority]).alias("priorityValue"), canonical_json(payload, kind).alias("rawJSON"))


def custom_events(rows: DataFrame, payload: str, type_identifier: str, priority: str, engine: str = I.ENGINE, context: str = I.CONTEXT) -> DataFrame:
    """Rows of doc_id, sequence and a struct column ``payload`` as events that union with ``events``."""
    e = erased(F.col(payload), rows.schema[payload].dataType, type_identifier, priority)
    out = rows.select("doc_id", F.col("sequence").cast("long").alias("sequence"), e.alias("e"))
    return out.select("doc_id", "sequence", F.col("e.typeIdentifier").alias("type"), F.col("e.priorityValue").alias("priority"), F.col("e.rawJSON").alias("payload"), F.lit(None).cast("string").alias("semantic_key"), F.lit(engine).alias("engine"), F.lit(context).alias("context"), F.lit(I.SCHEMA_VERSION).alias("schema_version"))


def extracted_payload(of=F.col) -> Column:
    """of: a verdict's columns by name."""
    return F.concat(F.lit('{"claimID":'), json_string(of("claim_id")), F.lit(',"claimType":'), json_string(of("type")), F.lit(',"fingerprint":'), json_string(of("fingerprint")), F.lit(',"text":'), json_string(of("text")), F.lit("}"))


def evidence_prints() -> Column:
    return F.transform(F.col("evidence"), lambda e: I.passage_fingerprint(e["text"]))


def verified_payload(of=F.col, prints: Column | None = None) -> Column:
    prints = evidence_prints() if prints is None else prints
    return F.concat(F.lit('{"claimFingerprint":'), json_string(of("fingerprint")), F.lit(',"confidence":'), json_number(of("confidence")), F.lit(',"evidenceFingerprints":'), json_strings(prints), F.lit(',"status":'), json_string(of("status")), F.lit("}"))


def finalized_payload(policy_fingerprint: Column) -> Column:
    counts = F.array_join(F.transform(F.map_entries("status_counts"), lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"].cast("string"))), ",")
    return F.concat(
        F.lit('{"policyFingerprint":'), json_string(policy_fingerprint), F.lit(',"reportFingerprint":'), json_string(F.col("report_fingerprint")), F.lit(',"safeToPublish":'), F.col("safe_to_publish").cast("string"),
        F.lit(f',"specVersion":"{I.SPEC_VERSION}","statusCounts":{{'), counts, F.lit("}}"),
    )


def semantic_key(of=F.col) -> Column:
    """Verdicts of one claim wording and status are comparable."""
    return F.concat_ws(":", F.lit(I.VERIFIED), of("fingerprint"), of("status"))


def events(verdicts: DataFrame, reports: DataFrame, policy: Policy | Column | None = None, engine: str = I.ENGINE, context: str = I.CONTEXT) -> DataFrame:
    """run (doc_id), sequence, type, priority, payload, semantic_key, engine, context, schema_version.

    Two events a claim and one a report; the sequence is arithmetic on the ordinal, so
    nothing is sorted.  policy: the one in use, or a column of ``reports`` with its
    fingerprint.
    """
    fingerprint = policy if isinstance(policy, Column) else F.lit(I.policy_fingerprint(policy or Policy()))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("type"), p.alias("payload"), s.alias("semantic_key")) for i, (k, p, s) in enumerate(((I.EXTRACTED, extracted_payload(), F.lit(None).cast("string")), (I.VERIFIED, verified_payload(), semantic_key())))]))
    own = verdicts.select("doc_id", "ordinal", kinds.alias("e")).select("doc_id", (F.col("ordinal") * 2 + F.col("e.i")).cast("long").alias("sequence"), "e.type", "e.payload", "e.semantic_key")
    last = reports.select("doc_id", (F.col("n_claims") * 2).cast("long").alias("sequence"), F.lit(I.FINALIZED).alias("type"), finalized_payload(fingerprint).alias("payload"), F.lit(None).cast("string").alias("semantic_key"))
    priority = F.when(F.col("type") == I.EXTRACTED, PRIORITY[I.EXTRACTED]).otherwise(PRIORITY[I.VERIFIED])
    return own.unionByName(last).select("doc_id", "sequence", "type", priority.alias("priority"), "payload", "semantic_key", F.lit(engine).alias("engine"), F.lit(context).alias("context"), F.lit(I.SCHEMA_VERSION).alias("schema_version"))


def edges(verdicts: DataFrame, reports: DataFrame) -> DataFrame:
    """doc_id, source_sequence, target_sequence, type: extracted -> verified, verified -> report."""
    own = verdicts.select("doc_id", (F.col("ordinal") * 2).cast("long").alias("s")).join(reports.select("doc_id", (F.col("n_claims") * 2).cast("long").alias("last")), "doc_id")
    both = F.explode(F.array(F.struct(F.col("s").alias("source_sequence"), (F.col("s") + 1).alias("target_sequence"), F.lit("verifiedBy").alias("type")), F.struct((F.col("s") + 1).alias("source_sequence"), F.col("last").alias("target_sequence"), F.lit("derivedFrom").alias("type"))))
    return own.select("doc_id", both.alias("e")).select("doc_id", "e.*")


def name_uuid(*parts: Column) -> Column:
    """A UUID that follows from its parts, for results that must be repeatable."""
    h = F.upper(F.md5(F.concat_ws("|", *parts).cast("binary")))
    cut = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


def with_ids(events: DataFrame, run_id: Column | None = None, event_id: Column | None = None) -> DataFrame:
    """Events with an event id each and one run id a document.

    Fresh event ids, which is what they are unless given, are not repeatable: write the
    result once and read it from there.
    """
    return events.withColumns({"event_id": F.upper(F.uuid()) if event_id is None else event_id, "run_id": name_uuid(F.lit("run"), F.col("doc_id").cast("string")) if run_id is None else run_id})


def resolved(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges with the event ids of their ends; an edge without an event drops."""
    at = lambda name: events.select("doc_id", F.col("sequence").alias(f"{name}_sequence"), F.col("event_id").alias(f"{name}_id"))
    return edges.join(at("source"), ["doc_id", "source_sequence"]).join(at("target"), ["doc_id", "target_sequence"])


def runs(events: DataFrame, engine: str = I.ENGINE) -> DataFrame:
    """doc_id, n_events, run_fingerprint over the events in order."""
    grouped = events.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "type"))).alias("e"))
    return grouped.select("doc_id", F.size("e").alias("n_events"), I.run_fingerprint(F.transform("e", lambda x: x["type"]), engine).alias("run_fingerprint"))


def _event_json() -> Column:
    """An envelope in the order of its keys; all events of a report carry the report's creation time."""
    payload = F.struct(F.col("priority").alias("priorityValue"), F.col("payload").alias("rawJSON"), F.col("type").alias("typeIdentifier"))
    return F.struct("sequence", F.struct(F.col("context").alias("contextID"), F.col("engine").alias("engineName"), F.col("event_id").alias("id"), payload.alias("payload"), F.col("run_id").alias("runID"), F.col("schema_version").alias("schemaVersion"), "sequence", F.col("_time").alias("timestamp")).alias("e"))


def event_arrays(identified: DataFrame, created_at: Column) -> DataFrame:
    """doc_id, events: a bare array of envelopes, in order, from events with ids."""
    rows = identified.withColumn("_time", F.unix_seconds(created_at) - REFERENCE_DATE)
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(_event_json())).alias("events")).select("doc_id", F.transform("events", lambda e: e["e"]).alias("events"))


def manifests(identified: DataFrame, edges: DataFrame, reports: DataFrame, created_at: Column, policy: Policy | None = None, engine: str = I.ENGINE, context: str = I.CONTEXT) -> DataFrame:
    """doc_id, json: versions, identities, events and edges of each report; ``identified``: events with ids, written once if these are fresh."""
    joined = resolved(edges, identified).select("doc_id", F.struct("target_sequence", "source_sequence", F.struct(F.col("source_id").alias("sourceID"), F.col("target_id").alias("targetID"), "type").alias("e")).alias("x"))
    lines = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    own = event_arrays(identified, created_at).join(runs(identified, engine), "doc_id").join(reports.select("doc_id", "report_fingerprint"), "doc_id").join(lines, "doc_id", "left")
    none = F.array().cast("array<struct<sourceID:string,targetID:string,type:string>>")
    return own.select("doc_id", _manifest(F.coalesce(F.transform("x", lambda e: e["e"]), none), F.col("events"), F.col("run_fingerprint"), policy, engine, context).alias("json"))


def _manifest(edges: Column, events: Column, run: Column, policy: Policy | None, engine: str, context: str) -> Column:
    whole = F.struct(
        F.lit(BRIDGE_VERSION).alias("bridgeVersion"), F.lit(context).alias("contextID"), edges.alias("edges"), F.lit(engine).alias("engineName"), events.alias("events"),
        F.lit(I.policy_fingerprint(policy or Policy())).alias("policyFingerprint"), F.col("report_fingerprint").alias("reportFingerprint"), run.alias("runFingerprint"), F.lit(I.SPEC_VERSION).alias("specVersion"),
    )
    return F.to_json(whole)


# --- whole runs, document by document: the verdicts of a document are one list, from which events, edges and manifests follow where it lies


def outlined(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, n_claims and v, the ordinals of each document's claims: all that edges and run fingerprints depend on, whatever the verdicts."""
    return report.listed(claims.select("doc_id", F.struct("ordinal").alias("v")), documents).withColumn("n_claims", F.size("v"))


def traced(verdicts: DataFrame, documents: DataFrame) -> DataFrame:
    """``report.reports`` with v, each document's claims as its events need them; one shuffle at most, none of ``verify.gathered``."""
    own = F.struct("ordinal", "claim_id", "fingerprint", "status", "text", "type", "confidence", evidence_prints().alias("prints"))
    return report.of_lists(report.listed(verdicts.select("doc_id", own.alias("v")), documents), "v")


def traced_events(runs: DataFrame, policy: Policy | None = None, engine: str = I.ENGINE, context: str = I.CONTEXT) -> DataFrame:
    """The rows of ``events`` for rows of ``traced``."""
    rows = runs.select("doc_id", F.explode(_listed_events(I.policy_fingerprint(policy or Policy()))).alias("e"))
    return rows.select("doc_id", "e.*", F.lit(engine).alias("engine"), F.lit(context).alias("context"), F.lit(I.SCHEMA_VERSION).alias("schema_version"))


def _listed_events(policy_fingerprint: str) -> Column:
    """sequence, type, priority, payload, semantic_key of a document's events in order."""

    def event(sequence: Column, kind: str, payload: Column, key: Column | None = None) -> Column:
        key = F.lit(None).cast("string") if key is None else key
        return F.struct(sequence.cast("long").alias("sequence"), F.lit(kind).alias("type"), F.lit(PRIORITY[kind]).alias("priority"), payload.alias("payload"), key.alias("semantic_key"))

    def both(x: Column) -> Column:
        return F.array(event(x["ordinal"] * 2, I.EXTRACTED, extracted_payload(x.getField)), event(x["ordinal"] * 2 + 1, I.VERIFIED, verified_payload(x.getField, x["prints"]), semantic_key(x.getField)))

    return F.concat(F.flatten(F.transform("v", both)), F.array(event(F.col("n_claims") * 2, I.FINALIZED, finalized_payload(F.lit(policy_fingerprint)))))


def _listed_edges() -> Column:
    """The edges of a document, by where they lead and start."""
    last = (F.col("n_claims") * 2).cast("long")
    at = lambda x, k: (x["ordinal"] * 2 + k).cast("long")
    edge = lambda s, t, kind: F.struct(t.alias("target_sequence"), s.alias("source_sequence"), F.lit(kind).alias("type"))
    return F.array_sort(F.flatten(F.transform("v", lambda x: F.array(edge(at(x, 0), at(x, 1), "verifiedBy"), edge(at(x, 1), last, "derivedFrom")))))


def outlined_edges(runs: DataFrame) -> DataFrame:
    """The rows of ``edges`` for rows of ``outlined`` or ``traced``."""
    return runs.select("doc_id", F.explode(_listed_edges()).alias("e")).select("doc_id", "e.source_sequence", "e.target_sequence", "e.type")


def _listed_run(engine: str) -> Column:
    types = F.concat(F.flatten(F.transform("v", lambda x: F.array(F.lit(I.EXTRACTED), F.lit(I.VERIFIED)))), F.array(F.lit(I.FINALIZED)))
    return I.run_fingerprint(types, engine)


def outlined_runs(runs: DataFrame, engine: str = I.ENGINE) -> DataFrame:
    """The rows of ``runs`` for rows of ``outlined`` or ``traced``."""
    return runs.select("doc_id", (F.col("n_claims") * 2 + 1).alias("n_events"), _listed_run(engine).alias("run_fingerprint"))


def traced_manifests(runs: DataFrame, created_at: Column, event_id: Callable[[Column, Column], Column], run_id: Column | None = None, policy: Policy | None = None, engine: str = I.ENGINE, context: str = I.CONTEXT) -> DataFrame:
    """The rows of ``manifests`` for rows of ``traced``; event_id: of doc_id and sequence, so that edges can name events."""
    run_id = name_uuid(F.lit("run"), F.col("doc_id").cast("string")) if run_id is None else run_id
    made = runs.select("doc_id", "report_fingerprint", "n_claims", "v", _listed_events(I.policy_fingerprint(policy or Policy())).alias("e"), run_id.alias("_run"), (F.unix_seconds(created_at) - REFERENCE_DATE).alias("_time"), _listed_run(engine).alias("_print"))
    # by sequence, so that the last event's id is at hand for each claim's
    made = made.withColumn("ids", F.transform("e", lambda x: event_id(F.col("doc_id"), x["sequence"])))

    def envelope(x: Column, i: Column) -> Column:
        payload = F.struct(x["priority"].alias("priorityValue"), x["payload"].alias("rawJSON"), x["type"].alias("typeIdentifier"))
        return F.struct(F.lit(context).alias("contextID"), F.lit(engine).alias("engineName"), F.get("ids", i).alias("id"), payload.alias("payload"), F.col("_run").alias("runID"), F.lit(I.SCHEMA_VERSION).alias("schemaVersion"), x["sequence"].alias("sequence"), F.col("_time").alias("timestamp"))

    def ends(x: Column, i: Column) -> Column:
        return F.struct(F.get("ids", i * 2).alias("a"), F.get("ids", i * 2 + 1).alias("b"))

    edge = lambda a, b, kind: F.struct(a.alias("sourceID"), b.alias("targetID"), F.lit(kind).alias("type"))
    pairs = F.transform("v", ends)
    last = F.get("ids", F.size("v") * 2)
    edges = F.concat(F.transform(pairs, lambda p: edge(p["a"], p["b"], "verifiedBy")), F.transform(pairs, lambda p: edge(p["b"], last, "derivedFrom")))
    return made.select("doc_id", _manifest(edges, F.transform("e", envelope), F.col("_print"), policy, engine, context).alias("json"))
