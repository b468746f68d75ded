"""One large JSON document as rows: the elements of its arrays, read by many tasks.

Spark's text reader splits a file anywhere; here it cuts at commas, so that a task has
the pieces between the commas of its block.  Whether a comma separates elements depends
on all text before it, but only through numbers that add up: quotes so far (odd: inside a
string), brackets opened and not closed, commas seen at each depth.  Each is a sum within
a block plus the block's start, and the starts are sums over one row a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.operators.stored import stored

#: Commas at these depths are counted: members, elements of a member, elements of a member's member.
DEPTHS = (1, 2, 3)


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _running(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The sum of each value over all pieces of the file before a row, as columns of those names."""
    rows = rows.withColumns({f"_{c}": v for c, v in values.items()})
    blocks = rows.groupBy("path", "block").agg(*[F.sum(f"_{c}").alias(c) for c in values])
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_start") for c in values])
    within = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.col(f"_{c}_start") + F.coalesce(F.sum(f"_{c}").over(within), F.lit(0)) for c in values}
    return rows.join(starts, ["path", "block"]).withColumns(sums).drop(*[f"_{c}_start" for c in values])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, block, at, value (text between commas), depth (before it), c1, c2, c3: commas so far at each of DEPTHS."""
    rows = spark.read.text(path, lineSep=",").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartition("path", "block")  # a block is no more than Spark's reader gives one task
    rows = rows.withColumn("plain", F.regexp_replace("value", r"\\.", ""))
    rows = _running(rows, {"quotes": _count(F.col("plain"), '"')})
    inside = F.col("quotes") % 2 == 1
    rows = rows.withColumn("outside", F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), "plain"), '"[^"]*("|$)', "")).drop("plain")
    rows = _running(rows, {"depth": _count(F.col("outside"), r"[\[{]") - _count(F.col("outside"), r"[\]}]")})
    after, closed = F.col("depth") + F.col("_depth"), (F.col("quotes") + F.col("_quotes")) % 2 == 0
    rows = rows.drop("outside")
    return _running(rows, {f"c{d}": F.when(closed & (after == d), 1).otherwise(0) for d in DEPTHS}).select("path", "block", "at", "value", "depth", *[f"c{d}" for d in DEPTHS])


def _opening(keys: list[str]) -> str:
    """What stands before the value of the last of ``keys`` where it is its parents' first member; the parents are optional."""
    out = ""
    for parent in keys[:-1]:
        out = rf'(?:{out}\{{?\s*"\Q{parent}\E"\s*:\s*\{{\s*)?'
    return rf'\A\s*{out}\{{?\s*"\Q{keys[-1]}\E"\s*:\s*'


def _members(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces of the value of key.key, with ``c1`` (and ``c2``) of their own."""
    for depth in range(1, len(keys) + 1):
        by = ["path", *[f"c{d}" for d in range(1, depth + 1)]]
        first = rows.groupBy(*by).agg(F.min_by("value", F.struct("block", "at")).alias("first"))
        rows = rows.join(first.filter(F.col("first").rlike(_opening(keys[:depth]))).select(*by), by)
    return rows


#: What follows the last element: the array's end, and what closes around it.
_CLOSING = r"\]\s*(?:\}\s*)*\z"


def _units(rows: DataFrame, array: str) -> DataFrame:
    """path, block, at, place, last, value: the text of each element of the array, the first one with what opens and the last one with what closes it."""
    keys = array.split(".")
    if len(keys) > 2:
        raise ValueError(f"an array lies at most two keys deep: {array}")
    unit = f"c{len(keys) + 1}"
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    texts = _members(rows, keys).groupBy("path", unit).agg(parts.alias("p"))
    whole = Window.partitionBy("path")
    texts = texts.withColumns({"least": F.min(unit).over(whole), "most": F.max(unit).over(whole)})
    return texts.select("path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"), (F.col(unit) - F.col("least")).cast("int").alias("place"), (F.col(unit) == F.col("most")).alias("last"), F.array_join(F.transform("p", lambda x: x["value"]), ",").alias("value"))


def elements(spark: SparkSession, path: str, array: str, schema: T.StructType) -> DataFrame:
    """``elements_of`` the documents at ``path``."""
    return elements_of(pieces(spark, path), array, schema)


def elements_of(rows: DataFrame, array: str, schema: T.StructType) -> DataFrame:
    """path, place (from 0) and the fields of ``schema``: the objects of the array ``array`` (a key of the document, or key.key) of each document in ``pieces``.

    A missing array, an empty one and null have no elements; an element that is no object
    of the schema is an error.  Files must not be compressed to be split.
    """
    text = F.when(F.col("place") == 0, F.regexp_replace("value", _opening(array.split(".")) + r"\[", "")).otherwise(F.col("value"))
    text = F.when(F.col("last"), F.regexp_replace(text, _CLOSING, "")).otherwise(text)
    none = (F.col("place") == 0) & F.col("last") & (F.trim(F.regexp_replace("text", r"\s+", "")).isin("", "null") | F.col("value").rlike(_opening(array.split(".")) + r"null\s*\}*\s*\z"))
    rows = _units(rows, array).withColumn("text", text).filter(~none)
    object_ = F.when(F.col("text").rlike(r"\A\s*\{"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit(f"no object in {array}: "), F.substring("text", 1, 80))))
    return rows.select("path", "place", F.from_json(object_, schema, {"mode": "FAILFAST"}).alias("x")).select("path", "place", "x.*")


def head(spark: SparkSession, path: str, arrays: list[str], schema: T.StructType) -> DataFrame:
    """``head_of`` the documents at ``path``."""
    return head_of(pieces(spark, path), arrays, schema)


def head_of(rows: DataFrame, arrays: list[str], schema: T.StructType) -> DataFrame:
    """path and the fields of ``schema`` of each document in ``pieces``, with the ``arrays`` empty: what is left is small."""
    short, kept = None, rows
    for array in arrays:
        keys = array.split(".")
        own = ["path", *[f"c{d}" for d in range(1, len(keys) + 1)]]
        kept = kept.join(_members(rows, keys).select(*own).distinct(), own, "left_anti")
        ends = _units(rows, array).filter((F.col("place") == 0) | F.col("last"))
        opened, closed = F.max(F.when(F.col("place") == 0, F.regexp_extract("value", "(?s)(" + _opening(keys) + r"\[?)", 1))), F.max(F.when(F.col("last"), F.regexp_extract("value", f"({_CLOSING})", 1)))
        nothing = F.max(F.when((F.col("place") == 0) & F.col("value").rlike(_opening(keys) + "null"), F.col("value")))
        ends = ends.groupBy("path").agg(F.min(F.struct("block", "at", F.lit("").alias("value"))).alias("p"), F.coalesce(nothing, F.concat(opened, closed)).alias("value"))
        ends = ends.select("path", F.col("p.block").alias("block"), F.col("p.at").alias("at"), "value")
        short = ends if short is None else short.union(ends)
    both = kept.select("path", "block", "at", "value")
    both = both if short is None else both.union(short)
    whole = both.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), ",")
    return whole.select("path", F.from_json(text, schema, {"mode": "FAILFAST"}).alias("x")).select("path", "x.*")


@dataclass(frozen=True)
class Document:
    """A document as rows: ``head`` is one row of its fields with the long arrays empty, ``lists`` has a table of place and fields for each of these."""

    head: DataFrame
    lists: dict[str, DataFrame]

    @classmethod
    def read(cls, spark: SparkSession, path: str, schema: T.StructType, arrays: dict[str, str]) -> Document:
        """arrays: the name of each list and where it lies; many tasks read it."""

        def element(where: str) -> T.StructType:
            of: T.DataType = schema
            for key in where.split("."):
                of = of[key].dataType  # type: ignore[index]
            return of.elementType  # type: ignore[attr-defined]

        rows = stored(pieces(spark, path))  # read once, whatever is asked of the document
        whole = stored(head_of(rows, list(arrays.values()), schema).drop("path"))
        return cls(whole, {name: stored(elements_of(rows, where, element(where)).drop("path")) for name, where in arrays.items()})
