"""JSON sources, the bridge, the command line, streams."""

import json

import pytest
from pyspark.sql import functions as F

from attestra import bridge, cli
from attestra.operators import extract, verify
from attestra.sources import json as J
from attestra.streaming import verify as streaming

INPUT = {"document": "The court granted the motion. The clerk lost the whole file.", "evidence": [{"id": "p", "source": "s", "text": "The court granted the motion."}]}


def test_missing_and_wrong_source_types(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(INPUT))
    bad.write_text(json.dumps(INPUT | {"evidence": [INPUT["evidence"][0] | {"sourceType": "rumour"}]}))
    assert J.inputs(spark, str(good))[1].first()["source_type"] == "unknown"
    with pytest.raises(Exception, match="unknown sourceType"):
        J.inputs(spark, str(bad))[1].collect()


def requests(spark, *items):
    rows = [(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(items)]
    got = bridge.respond(spark.createDataFrame(rows, "request_id long, request string"))
    return {r["request_id"]: json.loads(r["response"]) for r in got.collect()}


def test_bridge(spark):
    policy = {"policy": {"maximumEvidenceMatches": -1}}
    got = requests(spark, INPUT, "not json", INPUT | policy, INPUT | {"includeProvenance": True, "runID": "nope"}, INPUT | {"includeMarkdown": True, "includeProvenance": True, "policy": {"supportedThreshold": 0.9}}, {"document": "", "evidence": []})
    assert got[0]["decision"]["disposition"] == "block" and len(got[0]["report"]["verdicts"]) == 2 and "markdown" not in got[0]
    assert got[0]["policyFingerprint"] == "2f7f3374f9569df303c94cf3a050898e3608269a2e8c8d3aa00d56161642f3e0"
    assert [got[i]["error"]["code"] for i in (1, 2, 3)] == ["invalidRequest"] * 3 and "non-negative" in got[2]["error"]["message"]
    assert got[4]["policyFingerprint"] == "5b01a467c93e6fa46cc25b4530d1ae56a9bd84087d5cbad055085f9797f1d90f" and got[4]["markdown"].startswith("# ")
    assert len(json.loads(got[4]["provenanceManifest"])["events"]) == 5
    assert got[5]["decision"]["disposition"] == "allow" and got[5]["report"]["verdicts"] == []


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "in.json"
    path.write_text(json.dumps(INPUT))
    assert cli.main(["verify", str(path)], spark) == 2 and "BLOCKED" in capsys.readouterr().out
    path.write_text(json.dumps(INPUT | {"document": "The court granted the motion."}))
    out = tmp_path / "trace"
    assert cli.main(["verify", str(path), "--provenance", str(out)], spark) == 0 and spark.read.json(str(out / "events")).count() == 3
    assert cli.main(["verify", str(tmp_path / "none.json")], spark) == 65 and cli.main(["frobnicate", "x"], spark) == 64
    assert cli.main([str(path)], spark) == 0 and "PASS" in capsys.readouterr().out  # a path alone is verified
    assert cli.main([str(tmp_path / "none.json")], spark) == 65 and cli.main(["benchmark"], spark) == 64 and cli.main(["--help-me"], spark) == 64


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, INPUT["document"]) for i in range(4)], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    evidence = spark.createDataFrame([("all", 0, "p", "s", "unknown", INPUT["evidence"][0]["text"])], "scope string, evidence_ordinal int, id string, source string, source_type string, text string")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))
    streaming.verdicts(stream, evidence, sink, str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "ordinal", "status").collect()
    want = verify.verdicts(extract.claims(docs).withColumn("scope", F.lit("all")), evidence).select("doc_id", "ordinal", "status").collect()
    assert sorted(got) == sorted(want) and len(got) == 8
