"""Equi-joins with heavy keys: a sketch finds them, and their rows are cut in pieces.

A key with more than ``share`` of a side's rows is cut in so many pieces that none holds
more; the other side's rows of that key go to each piece.  Every pair meets once, as in a
plain join.  The sketch (frequent items) names all keys above the share, and at most
``1 / share`` of them exist, so that what comes to the driver and goes into the plan is
bounded whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch: its error is a few ten-thousandths of the rows.
TRACKED = 10_000
#: So many times the pieces that even ones would take: a hash deals them unevenly.
SPARE = 1.25


def pieces(rows: DataFrame, keys: list[str], share: float, at_least: int = 0) -> dict[int, int]:
    """Hash of each heavy key (of more than ``at_least`` rows) and the pieces it is cut into."""
    most = int(2 / share)
    row = rows.select(F.xxhash64(*keys).alias("h")).agg(F.expr(f"approx_top_k(h, {most}, {max(TRACKED, 8 * most)})").alias("top"), F.count("*").alias("n")).first()
    least = max(share * row["n"], at_least)
    return {x["item"]: int(-(-SPARE * x["count"] // least)) for x in row["top"] or [] if x["count"] > least > 0}


def _looked_up(found: dict[int, int], key: Column) -> Column:
    if not found:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for kv in found.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(1))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], left_by: str, right_by: str | None = None, share: float = 0.01, at_least: int = 10_000) -> DataFrame:
    """The inner join on ``keys``; pieces are dealt by a hash of ``left_by`` and ``right_by``.

    right_by None: no key occurs twice on the right, so only the left is looked at.
    at_least: so many rows of one key never hurt.
    """
    found = {"l": pieces(left, keys, share, at_least), "r": pieces(right, keys, share, at_least) if right_by else {}}
    if not found["l"] and not found["r"]:
        return left.join(right, keys)

    def dealt(rows: DataFrame, mine: str, theirs: str, by: str | None) -> DataFrame:
        h = F.xxhash64(*keys)
        own, copies = _looked_up(found[mine], h), _looked_up(found[theirs], h)
        return rows.withColumn(f"_{mine}", F.pmod(F.xxhash64(F.lit(7), *([by] if by else [])), own).cast("int")).withColumn(f"_{theirs}", F.explode(F.sequence(F.lit(0), copies - 1)))

    return dealt(left, "l", "r", left_by).join(dealt(right, "r", "l", right_by), [*keys, "_l", "_r"]).drop("_l", "_r")
