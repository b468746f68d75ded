"""JSON documents with explicit schemas: a missing sourceType is unknown, a wrong one an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra import schemas as S
from attestra.sources.elements import Document


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document a file, malformed ones an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def source_type(x: Column) -> Column:
    """``unknown`` where it is missing; a value outside the domain fails the query."""
    return F.when(x.isNull(), "unknown").when(x.isin(*S.SOURCE_TYPES), x).otherwise(F.raise_error(F.concat(F.lit("unknown sourceType: "), x)))


def passages(array: Column) -> Column:
    """An array of passages with checked source types."""
    return F.transform(array, lambda e: F.struct(e["id"].alias("id"), e["source"].alias("source"), source_type(e["sourceType"]).alias("sourceType"), e["text"].alias("text")))


def parsed(rows: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Rows whose JSON string ``column`` is decoded in place, malformed ones an error."""
    return rows.withColumn(column, F.from_json(column, schema, {"mode": "FAILFAST"}))


def inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and evidence of verify inputs, one file a document."""
    return split_inputs(read(spark, path, S.INPUT).withColumn("doc_id", F.input_file_name()))


def split_inputs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and evidence of rows of doc_id, document, evidence."""
    rows = rows.select("doc_id", "document", passages(F.col("evidence")).alias("evidence"))
    docs = rows.select("doc_id", F.col("document").alias("text"))
    e = rows.select(F.col("doc_id").alias("scope"), F.posexplode("evidence").alias("evidence_ordinal", "e"))
    return docs, e.select("scope", "evidence_ordinal", "e.id", "e.source", F.col("e.sourceType").alias("source_type"), "e.text")


def corpus(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """A benchmark corpus: version, name and metadata, claim cases with their places, extraction cases."""
    d = Document.read(spark, path, S.CORPUS, {"claimCases": "claimCases", "extractionCases": "extractionCases"})
    head = d.head.select("version", "name", "metadata").first().asDict(recursive=True)
    return head, claim_cases(d.lists["claimCases"]), d.lists["extractionCases"].drop("place")


def claim_cases(rows: DataFrame) -> DataFrame:
    """Cases with checked source types."""
    return rows.withColumn("evidence", passages(F.col("evidence")))


def candidates(spark: SparkSession, path: str) -> Document:
    return Document.read(spark, path, S.CANDIDATES, {"candidates": "candidates"})


def ledger(spark: SparkSession, path: str) -> Document:
    return Document.read(spark, path, S.LEDGER, {"sources": "sources"})


def manifest(spark: SparkSession, path: str) -> Document:
    return Document.read(spark, path, S.MANIFEST, {"candidates": "candidateCorpus.candidates", "assignments": "assignments"})


def submission(spark: SparkSession, path: str) -> Document:
    return Document.read(spark, path, S.SUBMISSION, {"responses": "responses"})
