"""The opN_<name> queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import byte_bpe, compression_classifier, decontamination, fill_in_middle, fuzzy_passages, packing, pii, ppm, quality_rules, simhash, substring_dedup, top_k, whitening
from attestra.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), fold(5) != 1)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability"
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark), count="n_found")


def op8_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages.passages(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compression_classifier.fit(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    scored = compression_classifier.score(docs, model)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.transform(vectors, whitening.fit(vectors)).withColumn("deviation", F.col("deviation").cast("long"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["length"])
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_ppm, op2_packing, op3_suffix_dedup, op4_quality_rules, op5_byte_bpe, op6_simhash, op7_pii, op8_fuzzy_passages, op9_quality_classifier, op10_top_k, op11_whitening, op12_fill_in_middle, op13_decontamination)}


OP10_SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+'), lambda u: length(u)) AS units
  FROM documents
), h AS (
  SELECT doc_id, t, units, len(units) AS n,
    CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, CAST(coalesce(list_sum(units[1:least(h1 % (n + 1), h2 % (n + 1))]), 0) AS BIGINT) AS low, CAST(coalesce(list_sum(units[1:greatest(h1 % (n + 1), h2 % (n + 1))]), 0) AS BIGINT) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(low AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(high - low AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || substr(t, 1, low) || '<S>' || substr(t, high + 1) || '<M>' || substr(t, low + 1, high - low)
    WHEN 'spm' THEN '<S>' || substr(t, high + 1) || '<P>' || substr(t, 1, low) || '<M>' || substr(t, low + 1, high - low) ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


_WORDS_13 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, {_WORDS_13} AS words FROM documents
), i AS (
  SELECT item_id, words, least(len(words), 10) AS k FROM (SELECT item_id, {_WORDS_13} AS words FROM benchmark) WHERE len(words) > 0
), w AS (
  SELECT DISTINCT item_id, k, array_to_string(words[s:s + k - 1], ' ') AS win FROM (SELECT item_id, k, words, unnest(generate_series(1, len(words) - k + 1)) AS s FROM i)
), p AS (
  SELECT doc_id, k, s, array_to_string(words[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, k, words, unnest(generate_series(1, len(words) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM w) WHERE len(words) >= k)
), m AS (
  SELECT p.doc_id, p.k, p.s, w.item_id FROM p JOIN w USING (k, win)
), h AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS place FROM (SELECT DISTINCT doc_id, k, s FROM m)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_top_k": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_decontamination": OP13_SQL}
