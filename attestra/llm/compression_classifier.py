"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts.
A text is compressed with each; the difference of the two sizes, per byte of text,
says which class it resembles.  A logistic curve, fitted on labelled texts that the
dictionaries have not seen, turns the difference (and the better of the two ratios,
which shows how repetitive the text is) into a probability of label 1.

The model is fitted on a bounded sample of labelled rows: ``sample`` documents of each
class and ``sample_bytes`` of their texts, the first by a hash of doc_id.  Scoring is narrow: each whole text meets the
model in its own task, and only the model (two dictionaries, four weights) is sent.

Defined results: a null or empty text scores the base rate of label 1 in the sample;
a label other than 0 or 1 is ignored; of several labels of a doc_id the smallest
counts; a class without labels gives the other class's base rate to all; null doc_ids are scored and
never learned from; columns of other names are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import checkpoint, strings, texts

#: Labelled documents of each class that a fit uses at most, bytes of their texts, and bytes of a dictionary.
SAMPLE, SAMPLE_BYTES = 1500, 32 << 20
DICTIONARY_BYTES, LEVEL = 16384, 3


@dataclass(frozen=True)
class Model:
    """dictionaries: of label 0 and 1, empty where a class had too few texts."""

    dictionaries: tuple[bytes, bytes]
    weights: tuple[float, ...]
    base: float
    level: int = LEVEL

    def compressors(self) -> list:
        import zstandard

        out = []
        for raw in self.dictionaries:
            own = zstandard.ZstdCompressionDict(raw) if raw else None
            if own:
                own.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=own, write_content_size=False, write_dict_id=False))
        return out

    def features(self, batch: list[str], compressors: list) -> np.ndarray:
        raw = [x.encode() for x in batch]
        size = np.array([len(x) for x in raw], float)
        bad, good = (np.array([len(c.compress(x)) for x in raw], float) for c in compressors)
        n = np.maximum(size, 1)
        return np.column_stack([np.ones(len(raw)), 100 * (bad - good) / n, (bad - good) / np.sqrt(n), np.minimum(bad, good) / n, np.log(n)])

    def scores(self, batch: list[str], compressors: list) -> np.ndarray:
        if not self.weights:
            return np.full(len(batch), self.base)
        x = 1 / (1 + np.exp(-np.clip(self.features(batch, compressors) @ np.array(self.weights), -40, 40)))
        return np.where([not t for t in batch], self.base, x)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by iteratively reweighted least squares."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w = x / scale, np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty
        step = np.linalg.solve(h, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, training: Column, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL) -> Model:
    """training: the rows of ``labels`` that may be learned from."""
    import zstandard

    known = labels.filter(training & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    picked = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    found = checkpoint(texts(docs).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").withColumn("_hash", F.xxhash64("doc_id", "text")))
    key = ["quality", "doc_id", "_hash"]
    sizes = found.groupBy(*key).agg(F.max(F.octet_length("text")).cast("long").alias("_size"))  # without texts; repeated rows count once
    before = F.sum("_size").over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", "_hash"))
    within = sizes.withColumn("_sum", before).filter(F.col("_sum") <= sample_bytes).drop("_size", "_sum")
    rows = found.dropDuplicates(key).join(within, key).collect()  # at most 2 x sample_bytes
    counts = known.groupBy("quality").count().collect()
    total = {r["quality"]: r["count"] for r in counts}
    base = total.get(1, 0) / sum(total.values()) if total else 0.5
    by = [list(dict.fromkeys(r["text"] for r in sorted(rows, key=lambda r: zlib.crc32(str(r["doc_id"]).encode())) if r["quality"] == q and r["text"])) for q in (0, 1)]
    if min(map(len, by)) < 2:
        return Model((b"", b""), (), base, level)
    dictionaries = []
    for own in by:
        half = [x.encode() for x in own[::2]]
        try:
            dictionaries.append(zstandard.train_dictionary(dictionary_bytes, half, level=level).as_bytes())
        except zstandard.ZstdError:  # too few or too uniform texts to train on: the texts themselves serve
            dictionaries.append(b"")
    model = Model((dictionaries[0], dictionaries[1]), (), base, level)
    rest = [own[1::2] for own in by]
    x = np.vstack([model.features(own, model.compressors()) for own in rest])
    y = np.repeat([0.0, 1.0], [len(own) for own in rest])
    weights = logistic(x, y)
    share = len(rest[1]) / len(y)  # the sample is balanced, the corpus is not
    weights[0] += np.log(max(base, 1e-6) / max(1 - base, 1e-6)) - np.log(share / (1 - share))
    return Model((dictionaries[0], dictionaries[1]), tuple(weights.tolist()), base, level)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = model.scores(strings(part.column("text")), compressors)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(found, pa.float64())})

    return texts(docs).mapInArrow(run, "doc_id long, score double")
