"""More operators as queries with the same rows in SQL: JSON in and out, benchmark cases and gates, annotation, provenance files.

Requests, corpora, ledgers, manifests and submissions are made from the driver's
tables: ``benchmark`` passages as claims and evidence, with faults dealt by item id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import bridge, render
from attestra import schemas as S
from attestra.functions import identity as I
from attestra.functions import text as X
from attestra.operators import annotation, benchmark, extract, ordinals, provenance, report, retrieve, verify
from attestra.operators.extract import claim_type
from attestra.operators.stored import stored
from attestra.plans.pipeline import Pipeline
from attestra.queries import (
    _ALL, _APPROVED, _CTE, _DISPOSED, _EVENTS, _EVIDENCE, _FNV, _PRINTS, _REPORTS, _RESULTS, _any, _documents, _evidence, _gathered, _ladder, _list, _reports, _results, _table, _terms, _tokens, _traced, _values, _verdicts, _with,
    query,
)
from attestra.schemas import STATUSES, Policy
from attestra.sources import json as J
from attestra.sources.elements import Document

# --- verdicts


@query(_with(*_ALL) + f"""SELECT r.doc_id, r.ordinal, r.rank, array_to_string(list_sort(list_distinct(list_filter({_terms("c.text")}, lambda t: list_contains(f.p_terms, t)))), ' ') AS matched
FROM ranked r JOIN claims c USING (doc_id, ordinal) JOIN facts f USING (evidence_ordinal) WHERE r.rank <= 3""")
def matched_terms(spark, sf_dir):
    # only the terms are kept; an explode of a plain column would have Spark compute it a second time for a filter
    own = _verdicts(spark, sf_dir).select("doc_id", "ordinal", F.transform("evidence", lambda e: e["matched_terms"]).alias("terms"))
    rows = own.select("doc_id", "ordinal", F.posexplode(F.transform("terms", lambda t: F.array_join(t, " "))).alias("at", "matched"))
    return rows.select("doc_id", "ordinal", (F.col("at") + 1).alias("rank"), "matched")


_SAID = "CASE rung " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in verify.EXPLANATIONS.items()) + " END"


@query(_with(*_ALL) + f"SELECT doc_id, ordinal, {_SAID} AS explanation FROM verdicts")
def explanations(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("doc_id", "ordinal", "explanation")


_FIRST_FIVE = _EVIDENCE.replace("AS id, ", "AS id, row_number() OVER (ORDER BY item_id) AS nth, ").replace("evidence AS (", "every_passage AS (") + ",\nevidence AS (SELECT * FROM every_passage WHERE nth <= 5)"


@query(_with(_CTE, _FIRST_FIVE, *_ALL[2:]) + "SELECT doc_id, ordinal, status, CAST(n_shown AS INTEGER) AS n_evidence FROM verdicts")
def composed_pipeline(spark, sf_dir):
    """Extraction, the first five passages of the scope, verdicts, reports and decisions by the composed plan."""
    docs = _documents(spark, sf_dir).withColumn("scope", F.lit("all"))
    v, _ = Pipeline(evidence_limit=5).run(docs, _evidence(spark, sf_dir))
    return v.select("doc_id", "ordinal", "status", F.size("evidence").alias("n_evidence"))


_BENCH_CLAIMS = "benchmark_documents AS (SELECT item_id AS doc_id, text FROM benchmark), " + _CTE.replace("FROM documents)", "FROM benchmark_documents)")


def _passages_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")


@query(_with(_BENCH_CLAIMS, _EVIDENCE) + f""",
q AS (SELECT doc_id, ordinal, unnest(list_distinct({_tokens("text")})) AS term FROM claims),
tf AS (SELECT DISTINCT evidence_ordinal, id, unnest({_tokens("text")}) AS term FROM evidence),
w AS (SELECT *, ln(((SELECT count(*) FROM evidence) - df + 0.5) / (df + 0.5) + 1) AS w FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term)),
s AS (SELECT doc_id, ordinal, id, sum(w ORDER BY term) AS score FROM q JOIN w USING (term) GROUP BY doc_id, ordinal, id)
SELECT doc_id, ordinal, rank, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 2""")
def bm25_clamped(spark, sf_dir):
    """Parameters outside their ranges: k1 below 0 counts as 0, which leaves the inverse document frequency alone."""
    own = extract.claims(_passages_as_documents(spark, sf_dir), False).withColumn("scope", F.lit("all"))
    return retrieve.bm25(own, _evidence(spark, sf_dir), 2, k1=-1.0, b=7.0).select("doc_id", "ordinal", "rank", F.round("score", 6).alias("score"))


@query(f"SELECT item_id, sha256(text) AS passage, {_FNV.format(x='text')} AS claim FROM benchmark")
def registered_functions(spark, sf_dir):
    I.register(spark)
    return _table(spark, sf_dir, "benchmark").select("item_id", F.expr("passage_fingerprint(text)").alias("passage"), F.expr("claim_fingerprint(text)").alias("claim"))


# --- files


@query(r"SELECT page_id, CASE WHEN url = '' THEN 'reviewer' ELSE regexp_replace(url, '[^\p{L}\p{N}_-]', '-', 'g') END AS name FROM pages")
def file_names(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", X.safe_file_name(F.col("url")).alias("name"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_dates(spark, sf_dir):
    """Times without a zone are UTC, whatever the session's zone."""
    own = _table(spark, sf_dir, "events")
    return own.select("event_id", I.iso_utc(F.to_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("at"))


@query(_with(*_ALL, _PRINTS, _REPORTS) + f"""SELECT doc_id, '{{"version":1,"disposition":"' || {_DISPOSED} || '","reportFingerprint":"' || report_fingerprint || '","policyFingerprint":"{I.policy_fingerprint(Policy())}","blockingClaimIDs":[' ||
  CASE WHEN blocking_ids = '' THEN '' ELSE '"' || replace(blocking_ids, ',', '","') || '"' END || '],"reviewClaimIDs":[' || CASE WHEN review_ids = '' THEN '' ELSE '"' || replace(review_ids, ',', '","') || '"' END ||
  '],"supportedClaimCount":' || n_supported || ',"totalClaimCount":' || n_claims || '}}' AS json FROM reports""")
def governance_json(spark, sf_dir):
    return report.signal_json(report.signals(_reports(spark, sf_dir)))


_PERCENT = "CAST(CAST(floor({x} * 100 + 0.5) AS BIGINT) AS VARCHAR)"


@query(_with(*_ALL, _PRINTS) + f""",
lines AS (
  SELECT r.doc_id, r.ordinal, string_agg('- `' || r.id || '` benchmark — ' || {_PERCENT.format(x="r.score")} || '% term coverage' || chr(10) || '  > ' || replace(e.text, chr(10), ' '), chr(10) ORDER BY r.rank) AS shown
  FROM ranked r JOIN evidence e USING (evidence_ordinal) WHERE r.rank <= 3 GROUP BY r.doc_id, r.ordinal
),
blocks AS (
  SELECT doc_id, ordinal, status = 'directlySupported' AS good, '## [' || upper(status) || '] ' || text || chr(10) || chr(10) || 'Type: `' || type || '` · Fingerprint: `' || fingerprint || '`' || chr(10) || chr(10) || {_SAID} ||
    CASE WHEN rung <> 'type' AND shown IS NOT NULL THEN chr(10) || shown ELSE '' END || chr(10) AS block
  FROM printed LEFT JOIN lines USING (doc_id, ordinal)
),
grouped AS (
  SELECT d.doc_id, count(block) AS n, count(block) FILTER (WHERE good) AS g, string_agg(block, chr(10) ORDER BY ordinal) AS body FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN blocks USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, sha256('# Claim Report' || chr(10) || chr(10) || '**Publish status:** ' || CASE WHEN n > 0 AND n = g THEN 'PASS' ELSE 'BLOCKED' END || chr(10) || '**Supported claims:** ' ||
  {_PERCENT.format(x="CASE WHEN n > 0 THEN g / n ELSE 0 END")} || '% (' || g || '/' || n || ')' || chr(10) || CASE WHEN n > 0 THEN chr(10) || body ELSE '' END) AS markdown FROM grouped""")
def report_markdown(spark, sf_dir):
    out = render.proof_reports(_gathered(spark, sf_dir), _documents(spark, sf_dir))
    return out.select("doc_id", F.sha2("markdown", 256).alias("markdown"))


_NAMED = "upper(substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-' || substr(md5({x}), 13, 4) || '-' || substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12))"
_EVENT_ID = _NAMED.format(x="'event|' || doc_id || '|' || sequence")


@query(_with(*_ALL, _PRINTS, _REPORTS, _EVENTS) + f""",
listed AS (
  SELECT doc_id, count(*) AS n, string_agg('{{"contextID":"attestra","engineName":"attestra","id":"' || {_EVENT_ID} || '","payload":{{"priorityValue":' || priority || ',"rawJSON":' || to_json(payload) || ',"typeIdentifier":"' || type || '"}},"runID":"' || {_NAMED.format(x="'run|' || doc_id")} || '","schemaVersion":1,"sequence":' || sequence || ',"timestamp":725857445}}', ',' ORDER BY sequence) AS events
  FROM events GROUP BY doc_id
),
links AS (
  SELECT doc_id, 2 * ordinal AS s, 2 * ordinal + 1 AS t, 'verifiedBy' AS type FROM printed
  UNION ALL SELECT doc_id, 2 * ordinal + 1, 2 * n_claims, 'derivedFrom' FROM printed JOIN reports USING (doc_id)
),
edged AS (
  SELECT doc_id, string_agg('{{"sourceID":"' || {_NAMED.format(x="'event|' || doc_id || '|' || s")} || '","targetID":"' || {_NAMED.format(x="'event|' || doc_id || '|' || t")} || '","type":"' || type || '"}}', ',' ORDER BY t, s) AS edges FROM links GROUP BY doc_id
)
SELECT doc_id, sha256('{{"bridgeVersion":"1.0","contextID":"attestra","edges":[' || coalesce(edges, '') || '],"engineName":"attestra","events":[' || events || '],"policyFingerprint":"{I.policy_fingerprint(Policy())}","reportFingerprint":"' || report_fingerprint ||
  '","runFingerprint":"' || sha1(repeat('cpk_claim_extracted:attestra|cpk_claim_verified:attestra|', CAST(n_claims AS BIGINT)) || 'cpk_report_finalized:attestra|') || '","specVersion":"1.0"}}') AS json
FROM reports JOIN listed USING (doc_id) LEFT JOIN edged USING (doc_id)""")
def provenance_manifests(spark, sf_dir):
    """With ids that follow from document and sequence, so that they can be compared."""
    named = lambda doc, sequence: provenance.name_uuid(F.lit("event"), doc.cast("string"), sequence.cast("string"))
    return provenance.traced_manifests(_traced(spark, sf_dir), F.timestamp_seconds(F.lit(1704164645)), named).select("doc_id", F.sha2("json", 256).alias("json"))


@query("""SELECT o_orderkey AS doc_id, CAST(7 AS BIGINT) AS sequence, 'host_order_seen' AS type, 1 AS priority,
  '{"customer":' || o_custkey || ',"note":"a\\/\\"b\\"","parts":["' || o_orderstatus || '","x\\/y"],"priority":"' || o_orderpriority || '","urgent":' || (o_orderpriority = '1-URGENT') || '}' AS payload FROM orders""")
def custom_events(spark, sf_dir):
    """A host's own event type, erased to canonical JSON; absent fields are left out."""
    fields = F.struct(F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("absent"), F.col("o_custkey").alias("customer"), F.array("o_orderstatus", F.lit("x/y")).alias("parts"), F.lit('a/"b"').alias("note"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(7).alias("sequence"), fields.alias("payload"))
    return provenance.custom_events(rows, "payload", "host_order_seen", "diagnostic").select("doc_id", "sequence", "type", "priority", "payload")


# --- JSON inputs


def _passage(name: str, source_type: Column) -> Column:
    return F.struct(F.lit(name).alias("id"), F.lit("benchmark").alias("source"), source_type.alias("sourceType"), F.col("text").alias("text"))


@query("SELECT item_id AS doc_id, sha256(text) AS document, CAST(k AS INTEGER) AS evidence_ordinal, CASE WHEN k = 0 THEN 'unknown' ELSE 'statute' END AS source_type, text AS passage FROM benchmark, range(2) t(k)")
def verify_inputs(spark, sf_dir):
    """Verify inputs as JSON and back; a missing source type is unknown."""
    written = F.to_json(F.struct(F.col("text").alias("document"), F.array(_passage("a", F.lit(None).cast("string")), _passage("b", F.lit("statute"))).alias("evidence")))
    rows = J.parsed(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), written.alias("r")), "r", S.INPUT)
    docs, evidence = J.split_inputs(rows.select("doc_id", "r.*"))
    return evidence.join(docs, evidence["scope"] == docs["doc_id"]).select("doc_id", F.sha2(docs["text"], 256).alias("document"), "evidence_ordinal", "source_type", evidence["text"].alias("passage"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case of each passage: as a claim against itself, or for odd ids against the next one."""
    own = ordinals.numbered(_table(spark, sf_dir, "benchmark"), "item_id")
    after = own.select((F.col("place") - 1).alias("place"), F.col("text").alias("next"))
    own, other = own.join(after, "place", "left"), F.coalesce("next", "text")
    i = F.col("item_id")
    kind = F.when(i % 7 == 6, "recommendation").otherwise("factual")
    evidence = F.array(F.struct(F.lit("p").alias("id"), F.lit("s").alias("source"), F.lit("courtRecord").alias("sourceType"), F.when(i % 2 == 0, F.col("text")).otherwise(other).alias("text")))
    expected = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (i % 7 + 1).cast("int"))
    category = F.element_at(F.array(*[F.lit(c) for c in S.CATEGORIES]), (i % 8 + 1).cast("int"))
    span = F.struct(F.lit("p").alias("evidenceID"), F.substring("text", 1, 10).alias("exactQuote"), F.when(i % 5 == 0, F.lit(0)).alias("startUTF16"), F.when(i % 5 == 0, F.lit(9)).alias("endUTF16"))
    matter = F.when(i % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" m"), (i % 13).cast("string"), F.lit(" ")))
    return own.select(
        i.cast("string").alias("id"), category.alias("category"), F.col("text").alias("claimText"), kind.alias("claimType"), evidence.alias("evidence"), expected.alias("expectedStatus"), F.lit("r").alias("rationale"),
        matter.alias("matterID"), F.array(F.lit("date"), F.lit("date"), F.when(i % 3 == 0, "actor").otherwise("amount")).alias("challengeTags"), F.array(span).alias("goldEvidenceSpans"),
    )


_CASE_CTE = f"""
cases AS (
  SELECT item_id, CAST(item_id AS VARCHAR) AS id, text, CASE WHEN item_id % 7 = 6 THEN 'recommendation' ELSE 'factual' END AS type, {_list(S.CATEGORIES)}[CAST(item_id % 8 + 1 AS INTEGER)] AS category,
    {_list(STATUSES)}[CAST(item_id % 7 + 1 AS INTEGER)] AS expected, CASE WHEN item_id % 2 = 0 THEN text ELSE coalesce(lead(text) OVER (ORDER BY item_id), text) END AS passage FROM benchmark
),
measured AS (
  SELECT *, {_terms("text")} AS c_terms, {_values("text")} AS c_values, {_any("text", X.NEGATIONS)} AS c_negated, {_any("text", X.SPECULATIVE)} AS c_speculative,
    {_terms("passage")} AS p_terms, {_values("passage")} AS p_values, {_any("passage", X.NEGATIONS)} AS p_negated, {_any("passage", X.SPECULATIVE)} AS p_speculative, 1 AS n_evidence, 'p' AS evidence_ids FROM cases
),
prepared AS (SELECT *, CASE WHEN len(list_intersect(c_terms, p_terms)) > 0 THEN len(list_intersect(c_terms, p_terms)) / len(c_terms) END AS score FROM measured),"""
_CASES = _CASE_CTE + _ladder()


@query(_with(_CASES) + "SELECT id, category, expected, status AS predicted, round(confidence, 9) AS confidence FROM verdicts")
def case_results(spark, sf_dir):
    """Benchmark cases through JSON and the verifier, each against its own evidence."""
    cases = _cases(spark, sf_dir)
    written = cases.select(F.to_json(F.struct(*cases.columns)).alias("r"))
    read = J.claim_cases(J.parsed(written, "r", S.CLAIM_CASE).select("r.*"))
    return benchmark.claim_results(read).withColumn("confidence", F.round("confidence", 9))


_CASE_RESULTS = "results AS (SELECT id, category, expected, status AS predicted, confidence FROM verdicts)"


@query(_with(_CASES, _CASE_RESULTS) + """SELECT count(*) FILTER (WHERE p) AS n_abstained, count(*) FILTER (WHERE e) AS n_to_abstain, count(*) FILTER (WHERE p AND e) AS n_right,
  round(CASE WHEN n_abstained = 0 THEN 1 ELSE n_right / n_abstained END, 9) AS abstention_precision, round(CASE WHEN n_to_abstain = 0 THEN 1 ELSE n_right / n_to_abstain END, 9) AS abstention_recall
FROM (SELECT predicted IN ('notVerifiable', 'ambiguous') AS p, expected IN ('notVerifiable', 'ambiguous') AS e FROM results)""")
def abstention_metrics(spark, sf_dir):
    m = benchmark.metrics(benchmark.claim_results(_cases(spark, sf_dir)))
    return m.select("n_abstained", "n_to_abstain", F.col("n_abstained_right").alias("n_right"), F.round("abstention_precision", 9).alias("abstention_precision"), F.round("abstention_recall", 9).alias("abstention_recall"))


@query("SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['date', CASE WHEN item_id % 3 = 0 THEN 'actor' ELSE 'amount' END]) AS tag FROM benchmark) GROUP BY tag")
def challenge_tags(spark, sf_dir):
    return benchmark.tag_counts(_cases(spark, sf_dir))


@query("SELECT count(DISTINCT item_id % 13) FILTER (WHERE item_id % 11 <> 0) AS n_matters, count(*) FILTER (WHERE item_id % 11 = 0) AS n_without FROM benchmark")
def matter_counts(spark, sf_dir):
    return benchmark.matters(_cases(spark, sf_dir))


_SPANS = f"""spans AS (
  SELECT id, contains(passage, substr(text, 1, 10)) AND substr(text, 1, 10) <> '' AND item_id % 5 <> 0 AS valid FROM cases WHERE expected IN {_APPROVED} OR expected = 'contradicted'
)"""


@query(_with(_CASES, _SPANS) + "SELECT id, valid FROM spans")
def required_spans(spark, sf_dir):
    """Gold spans of cases that need one; where bounds are given they are one unit short."""
    return benchmark.spans_required(_cases(spark, sf_dir))


_GATE = f"""c AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE expected = predicted) AS exact, count(*) FILTER (WHERE expected NOT IN {_APPROVED}) AS unsafe, count(*) FILTER (WHERE expected IN {_APPROVED}) AS good,
    count(*) FILTER (WHERE predicted IN {_APPROVED} AND expected NOT IN {_APPROVED}) AS dangerous, count(*) FILTER (WHERE predicted IN {_APPROVED}) AS approved, count(*) FILTER (WHERE predicted IN {_APPROVED} AND expected IN {_APPROVED}) AS approved_right,
    count(*) FILTER (WHERE expected = 'contradicted') AS con, count(*) FILTER (WHERE expected = 'contradicted' AND predicted = 'contradicted') AS con_found,
    count(*) FILTER (WHERE predicted NOT IN {_APPROVED}) AS flagged, count(*) FILTER (WHERE predicted NOT IN {_APPROVED} AND expected NOT IN {_APPROVED}) AS flagged_right FROM results
),
g AS (SELECT *, (SELECT count(DISTINCT item_id % 13) FROM cases WHERE item_id % 11 <> 0) AS matters, (SELECT count(*) FROM cases WHERE item_id % 11 = 0) AS without, (SELECT count(*) FROM spans WHERE NOT valid) AS bad,
  (SELECT count(*) FROM cases) AS dates, (SELECT count(*) FROM cases WHERE item_id % 3 = 0) AS actors, (SELECT count(*) FROM cases WHERE item_id % 3 <> 0) AS amounts,
  dangerous / unsafe AS p, 1.6448536269514722 * 1.6448536269514722 AS z2 FROM c),
b AS (SELECT *, CASE WHEN dangerous = 0 THEN 1 - pow(0.05, 1 / unsafe) ELSE least(1, ((p + z2 / (2 * unsafe)) + 1.6448536269514722 * sqrt(p * (1 - p) / unsafe + z2 / (4 * unsafe * unsafe))) / (1 + z2 / unsafe)) END AS bound FROM g)"""
_TAGS = " ".join(f", CASE WHEN {n} < 20 THEN 'challenge tag {t} count ' || {n} || ' < 20' END" for t, n in (("actor", "actors"), ("amount", "amounts"), ("compoundClaim", "0"), ("date", "dates"), ("modality", "0"), ("negation", "0"), ("quotation", "0"), ("sourceAuthority", "0")))


@query(_with(_CASES, _CASE_RESULTS, _SPANS, _GATE) + f"""SELECT exact / n >= 0.7 AND p <= 0 AND con_found / con >= 0.8 AS passes, CASE WHEN approved = 0 THEN true ELSE approved_right / approved >= 0.95 END AND flagged_right / unsafe >= 0.9 AS ships,
  concat_ws('; ', 'realistic-corpus metadata is missing', CASE WHEN without > 0 THEN 'one or more claim cases have no matterID' END, CASE WHEN matters < 50 THEN 'independent matter count ' || matters || ' < 50' END,
  CASE WHEN unsafe < 300 THEN 'non-approvable claim count ' || unsafe || ' < 300' END, CASE WHEN good < 100 THEN 'approval-eligible claim count ' || good || ' < 100' END, CASE WHEN dangerous > 0 THEN 'dangerous approval count ' || dangerous || ' != 0' END,
  CASE WHEN bound > 0.01 THEN 'false-supported 95% upper bound exceeds the required maximum' END, CASE WHEN approved_right / good < 0.8 THEN 'approval recall is below the required minimum' END, CASE WHEN con < 50 THEN 'contradiction case count ' || con || ' < 50' END,
  CASE WHEN con_found / con < 0.95 THEN 'contradiction recall is below the required minimum' END, 'extraction case count 0 < 50', CASE WHEN flagged_right / flagged < 0.8 THEN 'warning precision is below the required minimum' END{_TAGS},
  CASE WHEN bad > 0 THEN bad || ' approval-eligible/contradicted cases lack valid exact gold evidence spans' END) AS blockers FROM b""")
def benchmark_gates(spark, sf_dir):
    """The safety gate, the ship criteria and everything that stands against a release."""
    none = spark.createDataFrame([], S.EXTRACTION_CASE)
    r = benchmark.run("v1", "passages", None, _cases(spark, sf_dir), none)
    return spark.createDataFrame([(r.passes, r.ships, "; ".join(r.release_failures))], "passes boolean, ships boolean, blockers string")


@query(_with(*_ALL, _RESULTS) + """SELECT printf('| %.1f–%.1f | %d | %.2f | %.1f%% |', CAST(b / 5 AS DOUBLE), CAST((b + 1) / 5 AS DOUBLE), n, c, CAST(r * 100 AS DOUBLE)) AS line
FROM (SELECT least(4, CAST(floor(confidence * 5) AS INTEGER)) AS b, count(*) AS n, avg(confidence) AS c, avg((expected = predicted)::INT) AS r FROM results GROUP BY b)""")
def calibration_lines(spark, sf_dir):
    """The calibration table as a rendered report shows it."""
    bins = [r.asDict() for r in benchmark.calibration(_results(spark, sf_dir)).orderBy("bin").collect()]  # five rows
    return spark.createDataFrame([(render.calibration_line(b),) for b in bins if b["n_cases"]], "line string")


# --- the bridge


_ASKED = """asked AS (
  SELECT item_id AS doc_id, text, CASE WHEN item_id % 10 = 1 THEN 0.95 ELSE 0.8 END AS supported, item_id % 10 AS k FROM benchmark
)"""
_BRIDGE_PREPARED = f"""
pairs AS (SELECT c.*, a.text AS passage, a.supported FROM claims c JOIN asked a USING (doc_id)),
measured AS (
  SELECT *, {_terms("text")} AS c_terms, {_values("text")} AS c_values, {_any("text", X.NEGATIONS)} AS c_negated, {_any("text", X.SPECULATIVE)} AS c_speculative,
    {_terms("passage")} AS p_terms, {_values("passage")} AS p_values, {_any("passage", X.NEGATIONS)} AS p_negated, {_any("passage", X.SPECULATIVE)} AS p_speculative, 1 AS n_evidence, 'p' AS evidence_ids FROM pairs
),
prepared AS (SELECT *, CASE WHEN len(list_intersect(c_terms, p_terms)) > 0 THEN len(list_intersect(c_terms, p_terms)) / len(c_terms) END AS score FROM measured),"""


def _other_policy() -> str:
    return I.policy_fingerprint(Policy(supported=0.95))


@query(_with(_BENCH_CLAIMS, _ASKED, _BRIDGE_PREPARED + _ladder("supported"), _PRINTS, _REPORTS.replace("FROM documents)", "FROM benchmark_documents)")) + f"""
SELECT doc_id AS request_id, CASE WHEN k IN (3, 4, 5) THEN 'invalidRequest' ELSE '' END AS code,
  CASE k WHEN 3 THEN 'maximumEvidenceMatches must be non-negative: -1' WHEN 4 THEN 'the request is not a JSON object with document and evidence' WHEN 5 THEN 'runID is not a valid UUID: nope' ELSE '' END AS message,
  CASE WHEN k IN (3, 4, 5) THEN '' ELSE {_DISPOSED} END AS disposition, CASE WHEN k IN (3, 4, 5) THEN '' WHEN k = 1 THEN '{_other_policy()}' ELSE '{I.policy_fingerprint(Policy())}' END AS policy,
  CASE WHEN k IN (3, 4, 5) THEN '' ELSE report_fingerprint END AS report, CASE WHEN k IN (3, 4, 5) THEN 0 WHEN k = 6 THEN 2 * n_claims + 1 ELSE 0 END AS n_events
FROM asked JOIN reports USING (doc_id)""")
def bridge_responses(spark, sf_dir):
    """Requests with and without a policy of their own, and bad ones, all in one table."""
    k = F.col("item_id") % 10
    policy = F.struct(F.when(k == 1, 0.95).alias("supportedThreshold"), F.when(k == 3, -1).alias("maximumEvidenceMatches"))
    whole = F.struct(F.col("text").alias("document"), F.array(_passage("p", F.lit(None).cast("string"))).alias("evidence"), policy.alias("policy"), F.when(k.isin(5, 6), True).alias("includeProvenance"), F.when(k == 5, "nope").alias("runID"))
    requests = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.when(k == 4, "not json").otherwise(F.to_json(whole)).alias("request"))
    r = bridge.respond(requests)
    get = lambda path: F.coalesce(F.get_json_object("response", path), F.lit(""))
    events = F.size(F.split(F.coalesce(F.get_json_object("response", "$.provenanceManifest"), F.lit("")), '"typeIdentifier"')) - 1
    return r.select("request_id", get("$.error.code").alias("code"), get("$.error.message").alias("message"), get("$.decision.disposition").alias("disposition"), get("$.policyFingerprint").alias("policy"), get("$.reportFingerprint").alias("report"), events.cast("long").alias("n_events"))


# --- annotation


def _corpus(spark: SparkSession, sf_dir: str, faults: bool) -> tuple[Document, Document]:
    """Candidates and their ledger as rows, each through JSON; faults are dealt by item id."""
    own = ordinals.numbered(_table(spark, sf_dir, "benchmark"), "item_id").withColumn("place", F.col("place").cast("int"))
    i = F.col("item_id")
    odd = lambda n, r: F.lit(faults) & (i % n == r)
    name = i.cast("string")
    passage = F.struct(F.lit("p").alias("id"), F.lit("s").alias("source"), F.lit("courtRecord").alias("sourceType"), F.col("text").alias("text"))
    mapped = F.when(odd(9, 4), F.create_map(F.lit("q"), F.concat(F.lit("s"), name))).when(odd(9, 5), F.create_map(F.lit("p"), F.lit("s-none"))).otherwise(F.create_map(F.lit("p"), F.concat(F.lit("s"), name)))
    candidate = F.struct(
        F.concat(F.lit("c"), F.lpad(name, 6, "0")).alias("id"), F.when(odd(7, 1), " ").otherwise("m").alias("matterID"), F.col("text").alias("claimText"), claim_type(F.col("text")).alias("claimType"), F.array(passage).alias("evidence"),
        F.array(F.lit("date")).alias("challengeTags"), mapped.alias("evidenceSourceRecordIDs"),
    )
    source = F.struct(
        F.concat(F.lit("s"), name).alias("id"), F.when(odd(6, 2), "other").otherwise("m").alias("matterID"), F.when(odd(5, 1), "").otherwise("t").alias("title"), F.lit("u").alias("canonicalURL"), F.when(odd(8, 3), "statute").otherwise("courtRecord").alias("sourceType"),
        F.lit("j").alias("jurisdiction"), F.lit("d").alias("retrievedAt"), F.lit("publicRecordReusePermitted").alias("authorizationBasis"), F.lit("l").alias("licenseOrTerms"), (~odd(10, 7)).alias("redistributionPermitted"),
        F.when(odd(4, 3), "zz").otherwise(F.upper(F.sha2("text", 256))).alias("contentSHA256"), F.when(odd(12, 6), "pending").otherwise("notRequired").alias("deidentificationReview"), F.lit(False).alias("containsDirectPersonalIdentifiers"), F.lit(False).alias("containsRestrictedMaterial"),
    )
    read = lambda c, schema: J.parsed(own.select("place", F.to_json(c).alias("x")), "x", schema).select("place", "x.*")
    head = lambda **of: spark.createDataFrame([tuple(of.values())], ", ".join(f"{c} string" for c in of))
    corpus = Document(head(version="1", name="n", sourceLedgerVersion="L", annotationPolicyVersion="" if faults else "P"), {"candidates": read(candidate, S.CANDIDATE)})
    return corpus, Document(head(version="L"), {"sources": read(source, S.SOURCE_RECORD)})


@query("""WITH x AS (SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS place, 's' || item_id AS s, 'c' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS c FROM benchmark)
SELECT 0 AS section, 0 AS place, CAST(1 AS BIGINT) AS rule, 'annotation policy version is empty' AS issue
UNION ALL SELECT 1, place, 1, 'source ' || s || ' has no title' FROM x WHERE item_id % 5 = 1
UNION ALL SELECT 1, place, 6, 'source ' || s || ' is not cleared for benchmark redistribution' FROM x WHERE item_id % 10 = 7
UNION ALL SELECT 1, place, 9, 'source ' || s || ' has a pending de-identification review' FROM x WHERE item_id % 12 = 6
UNION ALL SELECT 1, place, 11, 'source ' || s || ' has an invalid SHA-256 digest' FROM x WHERE item_id % 4 = 3
UNION ALL SELECT 2, place, 1, 'candidate ' || c || ' has no matterID' FROM x WHERE item_id % 7 = 1
UNION ALL SELECT 2, place, 5, 'candidate ' || c || ' does not map every evidence passage to exactly one source record' FROM x WHERE item_id % 9 = 4
UNION ALL SELECT 2, place, 10, 'candidate ' || c || ' references unknown source s-none' FROM x WHERE item_id % 9 = 5
UNION ALL SELECT 2, place, 11, 'candidate ' || c || ' references source ' || s || ' from another matter' FROM x WHERE item_id % 9 NOT IN (4, 5) AND (item_id % 6 = 2 OR item_id % 7 = 1)
UNION ALL SELECT 2, place, 12, 'candidate ' || c || ' passage p has a source type that disagrees with ' || s FROM x WHERE item_id % 9 NOT IN (4, 5) AND item_id % 8 = 3""")
def intake_issues(spark, sf_dir):
    return annotation.intake_issues(*_corpus(spark, sf_dir, True)).withColumn("section", F.col("section").cast("int")).withColumn("place", F.col("place").cast("int"))


_ALIASES = ["ann", "bo", "cy"]


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.prepare(*_corpus(spark, sf_dir, False), [" ann", "bo ", "cy"], seed=7)


_PLACED = "x AS (SELECT item_id, text, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS place, 'c' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS c FROM benchmark), a AS (SELECT *, 'assignment-' || sha256('7|' || reviewer || '|' || c || '|' || place) AS assignment FROM x, (SELECT unnest(['ann', 'bo', 'cy']) AS reviewer))"


@query(f"WITH {_PLACED} SELECT reviewer, assignment AS \"assignmentID\", 'm' AS \"matterID\", sha256(text) AS claim, CAST(1 AS INTEGER) AS n_passages, CAST(row_number() OVER (PARTITION BY reviewer ORDER BY assignment) AS INTEGER) AS position FROM a")
def annotation_packets(spark, sf_dir):
    """Each reviewer's blinded packet, position by position."""
    p = annotation.packets(_prepared(spark, sf_dir))
    return p.select("reviewer", "assignmentID", "matterID", F.sha2("claimText", 256).alias("claim"), F.size("evidence").alias("n_passages"), "position")


@query(f"""WITH {_PLACED} SELECT reviewer, '{{"assignmentID":"' || assignment || '","approvalEligible":null,"status":null,"rationale":null,"evidenceSpans":[]}}' AS json FROM a""")
def annotation_templates(spark, sf_dir):
    return annotation.templates(_prepared(spark, sf_dir)).select("reviewer", "json")


def _submitted(spark: SparkSession, sf_dir: str, faulty: tuple[str, ...] = ()) -> tuple[Document, Document, Document, Document]:
    """A manifest, two primary submissions and an adjudication as rows, each response through JSON; labels of ``faulty`` reviewers have faults dealt by item id."""
    corpus, ledger = _corpus(spark, sf_dir, False)
    prepared = stored(annotation.prepare(corpus, ledger, _ALIASES, seed=7))
    i = F.substring("id", 2, 6).cast("int")
    base = F.when(i % 3 == 0, "unsupported").otherwise("directlySupported")
    status = {"ann": base, "bo": F.when(i % 16 == 5, "contradicted").otherwise(base), "cy": F.lit("partiallySupported")}

    def submission(who: str) -> Document:
        s, faults = status[who], who in faulty
        t = F.col("evidence")[0]["text"]
        quote = F.when(F.lit(faults) & (i % 6 == 1), F.concat(F.lit("~"), t)).otherwise(F.substring(t, 1, 12))
        span = F.struct(F.when(F.lit(faults) & (i % 6 == 2), "q").otherwise("p").alias("evidenceID"), quote.alias("exactQuote"), F.when(i % 4 == 0, F.lit(0)).alias("startUTF16"), F.when((i % 4 == 0) & ~(F.lit(faults) & (i % 8 == 4)), F.when(F.lit(faults) & (i % 12 == 8), 5).otherwise(12)).alias("endUTF16"))
        label = F.struct(F.col("assignment_id").alias("assignmentID"), ((s == "directlySupported") != (F.lit(faults) & (i % 10 == 9))).alias("approvalEligible"), s.alias("status"), F.when(F.lit(faults) & (i % 14 == 3), " ").otherwise("because").alias("rationale"), F.when(s == "unsupported", F.array().cast(S.LABEL["evidenceSpans"].dataType)).otherwise(F.array(span)).alias("evidenceSpans"))
        mine = prepared.filter(F.col("reviewer") == who)
        mine = mine.filter(i % 16 == 5) if who == "cy" else mine
        rows = J.parsed(mine.select("place", F.to_json(label).alias("x")), "x", S.LABEL).select("place", "x.*")
        head = spark.createDataFrame([("1", "1", who, "P")], "schemaVersion string, corpusVersion string, reviewerAlias string, annotationPolicyVersion string")
        return Document(head, {"responses": rows})

    return annotation.coordinator(corpus, prepared), *map(submission, _ALIASES)


@query("""WITH x AS (SELECT item_id AS i, 'reviewer ann, candidate c' || lpad(CAST(item_id AS VARCHAR), 6, '0') || ' ' AS who, length(text) AS n FROM benchmark)
SELECT who || 'has an approval/status mismatch' AS issue FROM x WHERE i % 10 = 9 UNION ALL SELECT who || 'has no rationale' FROM x WHERE i % 14 = 3
UNION ALL SELECT who || 'contains a non-byte-present evidence quote' FROM x WHERE i % 3 <> 0 AND i % 6 = 1 UNION ALL SELECT trim(who) || ' cites unknown evidence q' FROM x WHERE i % 3 <> 0 AND i % 6 = 2
UNION ALL SELECT who || 'provides only one UTF-16 span boundary' FROM x WHERE i % 3 <> 0 AND i % 6 <> 2 AND i % 8 = 4
UNION ALL SELECT who || 'has incorrect UTF-16 evidence boundaries' FROM x WHERE i % 3 <> 0 AND i % 6 <> 2 AND i % 4 = 0 AND i % 8 <> 4 AND (i % 12 = 8 OR i % 6 = 1)""")
def label_issues(spark, sf_dir):
    """The faults of one reviewer's labels."""
    manifest, first, _, _ = _submitted(spark, sf_dir, ("ann",))
    return annotation.label_issues(annotation._labels(manifest, first)).select("issue")


_BOTH = "y AS (SELECT *, item_id % 3 <> 0 AS a, item_id % 3 <> 0 AND item_id % 16 <> 5 AS b FROM x)"


@query(f"""WITH {_PLACED}, {_BOTH}, k AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS n_agree, avg(a::INT) AS pa, avg(b::INT) AS pb FROM y)
SELECT 'candidates' AS what, CAST(0 AS BIGINT) AS ordinal, CAST(n AS VARCHAR) AS value FROM k UNION ALL SELECT 'agree', 0, CAST(n_agree AS VARCHAR) FROM k UNION ALL SELECT 'adjudicator', 0, 'cy'
UNION ALL SELECT 'kappa', 0, printf('%.6f', CAST((n_agree / n - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) AS DOUBLE)) FROM k
UNION ALL SELECT 'disputed', row_number() OVER (ORDER BY c) - 1, c FROM y WHERE item_id % 16 = 5
UNION ALL SELECT 'sealed', row_number() OVER (ORDER BY assignment) - 1, assignment FROM a WHERE reviewer = 'cy' AND item_id % 16 = 5""")
def annotation_audit(spark, sf_dir):
    """The summary, and the lists of ids as rows in order."""
    manifest, first, second, _ = _submitted(spark, sf_dir)
    a = annotation.audit(manifest, [first, second])
    own = [("candidates", 0, str(a.summary["candidateCount"])), ("agree", 0, str(a.summary["binaryAgreementCount"])), ("adjudicator", 0, a.summary["adjudicatorAlias"]), ("kappa", 0, f"{a.summary['binaryLabelAgreement']:.6f}")]
    out = spark.createDataFrame(own, "what string, ordinal long, value string")
    for what, table, column in (("disputed", a.disputed, "id"), ("sealed", a.sealed, "id"), ("issue", a.issues, "issue")):
        out = out.unionByName(table.select(F.lit(what).alias("what"), "ordinal", F.col(column).alias("value")))
    return out


_FAULTS = """x AS (SELECT item_id AS i, 'reviewer ann, candidate c' || lpad(CAST(item_id AS VARCHAR), 6, '0') || ' ' AS who, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS place FROM benchmark),
kept AS (SELECT * FROM x WHERE i % 20 <> 14),
said AS (
  SELECT place, 0 AS rule, who || 'has an approval/status mismatch' AS issue FROM kept WHERE i % 10 = 9 UNION ALL SELECT place, 1, who || 'has no rationale' FROM kept WHERE i % 14 = 3
  UNION ALL SELECT place, 11, who || 'contains a non-byte-present evidence quote' FROM kept WHERE i % 3 <> 0 AND i % 6 = 1 UNION ALL SELECT place, 10, trim(who) || ' cites unknown evidence q' FROM kept WHERE i % 3 <> 0 AND i % 6 = 2
  UNION ALL SELECT place, 12, who || 'provides only one UTF-16 span boundary' FROM kept WHERE i % 3 <> 0 AND i % 6 <> 2 AND i % 8 = 4
  UNION ALL SELECT place, 13, who || 'has incorrect UTF-16 evidence boundaries' FROM kept WHERE i % 3 <> 0 AND i % 6 <> 2 AND i % 4 = 0 AND i % 8 <> 4 AND (i % 12 = 8 OR i % 6 = 1)
)"""


@query(f"""WITH {_FAULTS}, every AS (
  SELECT 1 AS section, CAST(0 AS BIGINT) AS pos, 0 AS rule, 'submission ann contains duplicate assignment IDs' AS issue WHERE (SELECT count(*) FROM x WHERE i % 20 = 15) > 0
  UNION ALL SELECT 1, 1, 0, 'submission ann is missing ' || (SELECT count(*) FROM x WHERE i % 20 = 14) || ' assignments' UNION ALL SELECT 1, 2, 0, 'submission ann contains 1 unexpected assignments'
  UNION ALL SELECT 2, place, rule, issue FROM said
  UNION ALL SELECT 2, place, rule, issue FROM said JOIN x USING (place) WHERE i % 20 = 15
)
SELECT CAST(row_number() OVER (ORDER BY section, pos, rule, issue) - 1 AS BIGINT) AS ordinal, issue FROM every""")
def audit_issues(spark, sf_dir):
    """A submission that lacks assignments, answers some twice and one that does not exist: what an audit says, in order."""
    manifest, first, second, _ = _submitted(spark, sf_dir, ("ann",))
    rows, i = first.lists["responses"], F.col("_i")
    rows = rows.join(manifest.lists["candidates"].select("place", F.substring("id", 2, 6).cast("int").alias("_i")), "place")
    foreign = rows.filter(i == 0).withColumns({"assignmentID": F.lit("assignment-none"), "place": F.col("place") + 1_000_000_000})
    rows = rows.filter(i % 20 != 14).unionByName(rows.filter(i % 20 == 15)).unionByName(foreign).drop("_i")
    return annotation.audit(manifest, [Document(first.head, {"responses": stored(rows)}), second]).issues.select("ordinal", "issue")


@query(f"""WITH {_PLACED} SELECT c AS id, sha256(text) AS claim, CASE WHEN item_id % 16 = 5 THEN 'partiallySupported' WHEN item_id % 3 = 0 THEN 'unsupported' ELSE 'directlySupported' END AS status,
  CASE WHEN item_id % 16 = 5 THEN 'partialSupport' WHEN item_id % 3 = 0 THEN 'unsupported' ELSE 'directSupport' END AS category, 'm' AS matter,
  CASE WHEN item_id % 16 <> 5 AND item_id % 3 = 0 THEN '' ELSE substr(text, 1, 12) END AS quote FROM x""")
def finalized_cases(spark, sf_dir):
    """Agreed labels, and the adjudicator's where the reviewers differ, as benchmark cases."""
    manifest, first, second, third = _submitted(spark, sf_dir)
    _, cases = annotation.finalize(manifest, [first, second], third, "publicRecord", "sealedHoldout")
    quote = F.coalesce(F.get("goldEvidenceSpans", F.lit(0))["exactQuote"], F.lit(""))
    return cases.select("id", F.sha2("claimText", 256).alias("claim"), F.col("expectedStatus").alias("status"), "category", F.col("matterID").alias("matter"), quote.alias("quote"))

