"""Whitening of embeddings by principal components, with covariances merged pairwise.

Each partition computes its count, exact sums and the scatter about its own mean; two of
them merge by Chan's formula (the scatters add up, and the difference of the means adds
its outer product), in a tree of reductions, so that the driver gets a few matrices of
d x d however many rows there are.  It decomposes the one that is left.  A second pass
measures the covariance of what the components give, in the same way, and a third one
returns rows.  Components are constants of the plan: a partition that is computed again
gives the same rows.

Entries are integers, ``floor(scale * c) + offset``; counts, sums and deviations are exact
whatever their size, and no covariance is a difference of large squares.

Defined results: vectors that are null or hold a null or a value that is not finite take
no part; an empty vector has no component and gives no row; vectors of different lengths
are tables of their own, each with its own fit; repeated and null vec_ids are rows like
any other; a component without variance (one row, equal rows, fewer rows than dimensions)
has whitened and explained 0 and is left out of the identity error.  An entry whose
integer needs more than 62 bits, or a deviation of more than 38 digits, is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch whose scatter is one matrix product.
ROWS = 4096
#: Levels of the tree: of p partitions, about p to the power 1 / DEPTH send their matrices to the driver.
DEPTH = 4


@dataclass
class Moments:
    """Of some rows: their number, their sums (exact where entries are integers) and the scatter about their mean."""

    n: int
    sums: list
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        """Chan's pairwise formula; the difference of the means is exact until its one division."""
        n, both = self.n + other.n, self.n * other.n
        gap = np.array([float(b * self.n - a * other.n) / both for a, b in zip(self.sums, other.sums, strict=True)])
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.scatter + other.scatter + np.outer(gap, gap) * (both / n))


#: Moments of the vectors of each length.
Fits = dict[int, Moments]


def merged(a: Fits, b: Fits) -> Fits:
    return {d: a[d].merged(b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def of_rows(x: np.ndarray) -> Moments:
    """Moments of integer rows; these are centred, as integers about a middle row, before anything is multiplied."""
    middle = x[0]
    y = (x - middle).astype(np.float64) if np.abs(x).max(initial=0) < 1 << 61 else (x.astype(object) - middle.astype(object)).astype(np.float64)
    y -= y.mean(axis=0)
    wide = len(x) * float(np.abs(x).max(initial=0)) >= 2**62
    return Moments(len(x), [int(s) for s in (x.astype(object) if wide else x).sum(axis=0)], y.T @ y)


def of_numbers(z: np.ndarray) -> Moments:
    y = z - z.mean(axis=0)
    return Moments(len(z), z.sum(axis=0).tolist(), y.T @ y)


def _groups(batch: pa.RecordBatch, scale: float, offset: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows' places and integer entries of the vectors of a batch, by their length and at most ROWS at a time."""
    lists = batch.column("embedding")
    values, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    sizes = np.diff(starts)
    for d in np.unique(sizes[sizes > 0]):
        every = np.flatnonzero(sizes == d)
        for at in range(0, len(every), ROWS):
            rows = every[at : at + ROWS]
            x = np.floor(scale * values[starts[rows][:, None] + np.arange(d)])
            if not (np.abs(x) < 2.0**62).all():
                raise ValueError("an entry of a vector needs more than 62 bits")
            yield int(d), rows, x.astype(np.int64) + offset


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the vectors that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return own.filter(F.col("embedding").isNotNull() & F.forall("embedding", finite))


def _reduced(vectors: DataFrame, moments: Callable[[pa.RecordBatch], Iterator[tuple[int, Moments]]], kind: type) -> Fits:
    """The merged moments of all partitions; ``moments`` gives those of a batch, whose sums are of ``kind``."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits: Fits = {}
        for batch in batches:
            for d, own in moments(batch):
                fits = merged(fits, {d: own})
        if fits:
            each = fits.items()
            yield pa.record_batch({
                "d": pa.array([d for d, _ in each], pa.int32()), "n": pa.array([m.n for _, m in each], pa.int64()),
                "sums": pa.array([list(map(str, m.sums)) for _, m in each], pa.list_(pa.string())), "scatter": pa.array([m.scatter.tobytes() for _, m in each], pa.binary()),
            })

    def read(row) -> Fits:
        return {row["d"]: Moments(row["n"], [kind(s) for s in row["sums"]], np.frombuffer(bytes(row["scatter"])).reshape(len(row["sums"]), -1))}

    parts = vectors.mapInArrow(local, "d int, n long, sums array<string>, scatter binary").rdd.map(read)
    return parts.treeAggregate({}, merged, merged, DEPTH)  # treeReduce with a result for no rows


@dataclass
class Whitening:
    """The fit for vectors of one length: components are rows, each over the root of its eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    @classmethod
    def of(cls, m: Moments, most: int) -> Whitening:
        values, vectors = np.linalg.eigh(m.scatter / m.n)
        values, vectors = values[::-1], vectors[:, ::-1].T
        least = values[0] * len(values) * np.finfo(float).eps * 8
        real = values > least if values[0] > 0 else np.zeros(len(values), bool)
        total = float(np.trace(m.scatter)) / m.n
        with np.errstate(divide="ignore", invalid="ignore"):
            components = np.where(real[:, None], vectors / np.sqrt(values)[:, None], 0.0)
        return cls(m.n, m.sums, components[:most], [float(v) / total if r else 0.0 for v, r in zip(values, real, strict=True)][:most])

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened rows, and the exact deviation of each."""
        peak = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))
        y = self.n * x - np.array(self.sums, np.int64) if peak < 1 << 62 else self.n * x.astype(object) - np.array(self.sums, object)
        far = max(int(y.max(initial=0)), -int(y.min(initial=0)))
        deviation = ((y if far * far * x.shape[1] < 1 << 62 else y.astype(object)) ** 2).sum(axis=1)
        return (y.astype(np.float64) / self.n) @ self.components.T, [int(v) for v in deviation]


def fit(vectors: DataFrame, scale: float = 1024.0, offset: int = 100_000, components: int = 8) -> dict[int, Whitening]:
    """A fit for each length of vectors, over all of them, and how far its covariance is from the identity."""
    own = usable(vectors)
    fits = _reduced(own, lambda batch: ((d, of_rows(x)) for d, _, x in _groups(batch, scale, offset)), int)
    out = {d: Whitening.of(m, components) for d, m in fits.items()}

    projected = lambda batch: ((d, of_numbers(out[d].apply(x)[0])) for d, _, x in _groups(batch, scale, offset))
    for d, m in _reduced(own, projected, float).items():
        real = out[d].components.any(axis=1)
        gap = m.scatter / m.n - np.eye(len(real))
        out[d].identity_error = float(np.abs(gap[np.ix_(real, real)]).max(initial=0.0))
    return out


def transform(vectors: DataFrame, fits: dict[int, Whitening], scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal(38,0)), whitened, explained, identity_error: a row for each vector and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _groups(batch, scale, offset):
                own = fits[d]
                z, deviation = own.apply(x)
                k = z.shape[1]
                every = len(rows) * k
                yield pa.record_batch({
                    "vec_id": batch.column("vec_id").take(pa.array(np.repeat(rows, k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), "n": pa.array(np.full(every, own.n, np.int64)),
                    "deviation": pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(rows)), k))), "whitened": pa.array(z.ravel()),
                    "explained": pa.array(np.tile(own.explained, len(rows))), "identity_error": pa.array(np.full(every, own.identity_error)),
                })

    return usable(vectors).mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
