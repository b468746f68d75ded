"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are quantised to integers, so scores are exact.  Queries and candidates meet
in blocks of bounded size; in a block every dimension has a list of the candidates
sorted by value, built once for all queries of the block.  A query walks its lists
in step (from the top where its weight is positive, from the bottom where it is
negative) and scores each candidate when it first appears.  The bound on everything
unseen is the inner product of the query with the values at the walk's depth; the
walk stops when the bound is below the k-th score, and goes on at equality, since an
unseen candidate could then win the tie by a smaller id.

Each block gives at most k ids a query, rows of one id merged before the cut; a window over a query's block results picks
the final ones.

Defined results: vectors that are null, empty or hold a null or a value that is not
finite take no part, as query or candidate; only vectors of one length meet; a query's
own id is no candidate; of several rows with one id the greatest score counts; ties go
to the smaller id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries of one block, and the depth of a walk's first step.
SHARD, BLOCK, STEP = 2048, 2048, 4


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of long): floor(scale * x) of each component, computed in doubles."""
    x = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(F.lit(float(scale)) * y)).alias("v"))


class Lists:
    """Candidates of a block with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # equal scores then go to the smaller id
        self.ids, self.x = ids[order], x[order]
        self.by = np.argsort(-self.x, axis=0, kind="stable")
        self.values = np.take_along_axis(self.x, self.by, axis=0)

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids for one query and the greatest score of each, by sorted access and the threshold."""
        n = len(self.ids)
        seen = self.ids == own
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STEP
        while depth < n:
            reach = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.by[depth:reach, up]] = True
            fresh[self.by[n - reach : n - depth, down]] = True
            if not len(up) and not len(down):
                fresh[:] = True  # a zero query: all tie at zero
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            seen[new] = True
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.x[new] @ q])
            best = np.lexsort((self.ids[rows], -scores))
            _, first = np.unique(self.ids[rows][best], return_index=True)  # rows of one id take one place, with the greatest score
            best = best[np.sort(first)[:k]]
            rows, scores = rows[best], scores[best]
            bound = int(self.values[reach - 1, up] @ q[up]) + int(self.values[n - reach, down] @ q[down])
            if seen.all() or len(rows) == k and bound < scores[-1]:
                break
            depth, step = reach, step * 2
        return self.ids[rows], scores


def _best(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if candidates.num_rows and queries.num_rows:
            values, offsets = _matrix(candidates)
            lists = Lists(candidates.column("vec_id").to_numpy(), values.reshape(-1, offsets))
            values, offsets = _matrix(queries)
            for own, q in zip(queries.column("vec_id").to_pylist(), values.reshape(-1, offsets), strict=True):
                ids, scores = lists.top(own, q, k)
                out_q.append(np.full(len(ids), own, np.int64))
                out_v.append(ids)
                out_s.append(scores)
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": join(out_q), "vec_id": join(out_v), "score": join(out_s)})

    return run


def _matrix(table: pa.Table) -> tuple[np.ndarray, int]:
    column = table.column("v").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), len(column[0])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with ``is_query`` the k best of all other rows."""
    own = quantised(vectors, scale).withColumn("size", F.size("v"))
    queries = own.filter(is_query)
    n, m = own.count(), queries.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = own.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    keys = ["size", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
