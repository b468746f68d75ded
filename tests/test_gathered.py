"""Whole runs document by document: the rows of the general operators, with claims judged once and moved once."""

import re

from pyspark.sql import functions as F

from attestra import queries as Q
from attestra import render
from attestra.operators import extract, provenance, report, verify

EVIDENCE = "scope string, evidence_ordinal int, id string, source string, source_type string, text string"
CREATED = 1704164645
SAID = ['The "court" granted a/b motion – on 3 May 2020.', "Rent was not paid in the whole of March.", "The clerk could have lost a file."]


def made(spark):
    docs = spark.createDataFrame([(i, " ".join(SAID[: i % 4]) + (" The judge recommends a\\b settlement. Zürich pays the rent and the clerk denied it." if i % 2 else "")) for i in range(12)] + [(12, None)], "doc_id long, text string")
    e = spark.createDataFrame([("all", i, f"p{i}", "src", "unknown", t.replace("not ", "")) for i, t in enumerate(SAID)], EVIDENCE)
    return docs, extract.claims(docs).withColumn("scope", F.lit("all")), e


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_traced_runs_equal_the_general_operators(spark):
    docs, claims, e = made(spark)
    v = verify.verdicts(claims, e).cache()
    own = verify.gathered(claims, e)
    assert rows(v) and rows(own) == rows(v)
    r, t = report.reports(v, docs), provenance.traced(own, docs)
    assert rows(t.drop("v").withColumn("status_counts", F.map_entries("status_counts"))) == rows(r.withColumn("status_counts", F.map_entries("status_counts")))
    events, edges = provenance.events(v, r), provenance.edges(v, r)
    outline = provenance.outlined(claims, docs)
    assert rows(provenance.traced_events(t)) == rows(events)
    assert rows(provenance.outlined_edges(outline)) == rows(edges) == rows(provenance.outlined_edges(t))
    assert rows(provenance.outlined_runs(outline)) == rows(provenance.runs(events)) == rows(provenance.outlined_runs(t))
    now = F.timestamp_seconds(F.lit(CREATED))
    name = lambda doc, sequence: provenance.name_uuid(F.lit("event"), doc.cast("string"), sequence.cast("string"))
    identified = provenance.with_ids(events, event_id=name(F.col("doc_id"), F.col("sequence")))
    assert rows(provenance.traced_manifests(t, now, name)) == rows(provenance.manifests(identified, edges, r, now))
    assert rows(render.proof_reports(own, docs)) == rows(render.proof_reports(v, docs))


def test_json_strings_are_those_of_the_writer(spark):
    texts = ["", "plain [text] {1}", 'a"b', "a/b", "a\\b", "tab\there", "line\n", "end\n\n", "é", "\x7f", " ", "'"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    whole = F.to_json(F.struct(F.coalesce("t", F.lit("")).alias("x")))
    want = F.replace(F.regexp_extract(whole, r'(?s)^\{"x":(.*)\}$', 1), F.lit("/"), F.lit("\\/"))
    assert all(r[0] == r[1] for r in df.select(provenance.json_string(F.col("t")), want).collect())


def of_claims(df):
    """Shuffles in the plan that have claims below them, and blocks that are kept."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[ :+-]*", line)[0])
    at = [i for i, line in enumerate(lines) if "Generate posexplode(flatten(" in line]
    above = 0
    for i in at:
        d = depth(lines[i])
        for line in lines[i::-1]:
            if depth(line) < d:
                d, above = depth(line), above + ("Exchange hashpartitioning" in line)
    return len(at), above, sum("InMemoryTableScan" in line for line in lines)


def test_claims_are_extracted_once_and_moved_once(spark):
    """Before: events, edges, manifests and run fingerprints read persisted verdicts, up to five times, and shuffled them by event and edge."""
    sf = "/root/testdata/sf0.001"
    for name in ("provenance_events", "provenance_edges", "provenance_manifests", "run_fingerprints", "report_markdown"):
        assert of_claims(Q.queries()[name](spark, sf)) == (1, 1, 0), name
    for name in ("provenance_edges", "run_fingerprints"):
        assert "best(" not in Q.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
