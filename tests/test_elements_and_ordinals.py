"""Large JSON documents read by many tasks; places over a whole table."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.operators import ordinals
from attestra.sources import elements as E



def schemas():
    ddl = T.StructType.fromDDL
    item = ddl("id string, n long, xs array<string>, e array<struct<text:string>>, m map<string,string>")
    whole = ddl("version string, note string, items array<struct<id:string>>, tags array<string>, corpus struct<version:string,name:string,items:array<struct<id:string>>>, more array<struct<id:string>>")
    return item, whole


def items(rng, n):
    odd = ['a,b', '"', '\\', '\\"', '{,}', '[1,2]', '],}', 'x\ny', 'é🧾,', '', 'null', '"items": [', ',,,"']
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 6)))
    return [{"id": str(i), "n": i * 7, "xs": [text() for _ in range(rng.randint(0, 3))], "e": [{"text": text()} for _ in range(rng.randint(0, 2))], "m": {"k" + text(): text()}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_elements_of_documents_cut_anywhere(spark, tmp_path, indent):
    item, whole = schemas()
    rng = random.Random(5)
    documents = {
        "a": {"version": "1,", "items": items(rng, 60), "note": 'x "items": [{', "tags": ["a", "b"], "corpus": {"version": "2", "items": items(rng, 40), "name": "n,{"}, "more": items(rng, 3)},
        "b": {"items": items(rng, 1), "corpus": {"items": items(rng, 2)}},
        "c": {"items": [], "version": "9", "corpus": {"name": "z", "items": []}, "more": None},
        "d": {"version": "only"},
        "e": {"corpus": {"version": "v", "name": "w", "items": items(rng, 5)}, "items": items(rng, 2)},
    }
    for name, d in documents.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=False))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        path = str(tmp_path)
        assert spark.read.text(path, lineSep=",").rdd.getNumPartitions() > 10
        for array in ("items", "more") if indent else ("corpus.items",):
            got = {}
            for r in E.elements(spark, path, array, item).orderBy("place").collect():
                got.setdefault(r["path"].rsplit("/", 1)[1][0], []).append((r["place"], r["id"], r["n"], r["xs"], [x["text"] for x in r["e"]], r["m"]))
            for name, d in documents.items():
                for key in array.split("."):
                    d = (d or {}).get(key)
                assert got.get(name, []) == [(i, x["id"], x["n"], x["xs"], [y["text"] for y in x["e"]], x["m"]) for i, x in enumerate(d or [])], (array, name)
        heads = {r["path"].rsplit("/", 1)[1][0]: r for r in E.head(spark, path, ["items", "corpus.items", "more"], whole).collect()}
        for name, d in documents.items():
            r, inner = heads[name], d.get("corpus") or {}
            assert (r["version"], r["note"], r["tags"]) == (d.get("version"), d.get("note"), d.get("tags"))
            assert (r["corpus"] and (r["corpus"]["version"], r["corpus"]["name"])) == (d.get("corpus") and (inner.get("version"), inner.get("name")))
            assert not r["items"] and not r["more"] and not (r["corpus"] and r["corpus"]["items"])
        (tmp_path / "f.json").write_text('{"items": [{"id": 5, "n": "no"}, 7]}')
        with pytest.raises(Exception):
            E.elements(spark, path, "items", item).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)


def test_numbered_rows(spark):
    rng = random.Random(1)
    values = [(rng.randrange(500), i) for i in range(3000)] + [(None, 5000), (None, 5001)]
    df = spark.createDataFrame(values, "a int, b int").repartition(7)
    got = ordinals.numbered(df, F.desc("a"), "b", name="n").collect()
    want = sorted(values, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])] == want and sorted(r["n"] for r in got) == list(range(len(values)))
    assert ordinals.numbered(df.limit(0), "a", "b").count() == 0
