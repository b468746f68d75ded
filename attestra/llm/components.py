"""Connected components of links between long ids, without a driver-side collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import checkpoint


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as stars: every id that is not its component's smallest, with the smallest."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:  # minimum-label hooking with pointer jumping, in whole arrays
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(ids))
    return ids[own], ids[root[own]]


def contract(links: DataFrame) -> DataFrame:
    """Links a, b of each partition as stars of its own components: fewer rows, the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column("a").to_numpy()])
            b = np.concatenate([b, batch.column("b").to_numpy()])
            if len(a) > 1_000_000:
                a, b = forest(a, b)
        if len(a):
            a, b = forest(a, b)
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in a link a-b.

    Large-star and small-star in turn: each id's greater neighbours, then its smaller
    ones, are tied to the smallest neighbour, until the links are stars.  The number
    of rounds grows with the logarithm of the component sizes; every round ends in a
    reliable checkpoint.  A hub's neighbours are never gathered: the minimum is a
    partial aggregate, and the join back to the links is a merge join, which adaptive
    execution splits; nothing is broadcast.
    """
    links = checkpoint(contract(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    last = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpoint(small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        # settled when a round leaves the same links
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        last = state
