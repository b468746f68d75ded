"""Positions of rows in an order over the whole table, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.stored import stored

#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
_WITHIN = (1 << 33) - 1


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``rows`` with their place from 0 by ``order``, which should have no ties: equal rows then take any of their places.

    Rows are dealt to ranges and sorted there; the ranges' counts, one row for each
    partition, give the place where each begins.
    """
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    dealt = dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(_WITHIN)})
    return dealt.join(F.broadcast(_starts(dealt)), "_part").withColumn(name, F.col("_start") + F.col("_at")).select(*rows.columns, name)


def _starts(dealt: DataFrame) -> DataFrame:
    """The place where each partition begins: as many rows as partitions, so one task sums them up."""
    n = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return n.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
