"""The registered queries over the smallest tables, and the pipeline stage by stage."""

from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_decontamination"])
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA), con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_operators import P, brute_removal, brute_rules, check_packing

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, texts = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
            texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(texts[0]) <= {d for d, t in source.items() if not brute_rules(t)[5]} and len(texts[0]) > 0.6 * len(source)
    assert len(set(texts[1].values())) == len(texts[1]) and set(texts[1]) <= set(texts[0])
    removed = brute_removal(list(texts[1].items()))
    assert all(len(texts[1][d].encode()) - len(t.encode()) >= removed[d][1] for d, t in texts[2].items())
    assert all((t == texts[1][d]) == (removed[d][1] == 0) for d, t in texts[2].items())
    assert set(texts[3]) == set(texts[2]) and not any("@mail" in t and t == source[d] for d, t in texts[3].items())
    bins, bound = check_packing(docs.collect(), texts[3], P.path("word_bpe_49k.json"))
    assert bins <= bound + 2
    assert sorted(corpus_pipeline.run(spark, DATA).columns) == sorted(docs.columns) and before is not None
