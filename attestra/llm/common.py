"""What the operators share: tables, shared storage, buckets and byte blobs."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one bucket of documents holds on average.
BUCKET_BYTES = 8 << 20
#: Stands for a null doc_id where documents are ordered: after all others.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name``, through Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, release: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a folder of its
    own; on a cluster, where executors could not see it, that is an error.
    release: shuffle files that only the cut lineage needs are let go at once, not when
    the driver next happens to collect its garbage; for shuffles of texts.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="attestra-"))
    out = df.checkpoint()
    del df
    if release:
        _let_go(spark)
    return out


def _let_go(spark: SparkSession) -> None:
    """Shuffles that no DataFrame needs any more are found by the driver's garbage collection.

    Listeners hold on to a query until they have seen its end, so their queue comes
    first; the gateway lets go of Java objects up to a second after Python does.
    """
    context = spark.sparkContext
    try:
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)  # type: ignore[union-attr]
    except Exception:  # noqa: BLE001  (a slow listener: files then stay a while longer)
        pass
    for pause in (1.3, 0.5, 0.5):  # what one collection frees may hold what the next one frees
        gc.collect()
        time.sleep(pause)
        context._jvm.System.gc()  # type: ignore[union-attr]


def texts(docs: DataFrame, *keys: str) -> DataFrame:
    """``doc_id`` and ``text`` (and ``keys``) alone, other columns, also clashing ones, go; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """``texts`` with NO_ID for a null doc_id, for operators that order documents."""
    return texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def unnumbered(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in columns})


def text_key(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one narrow aggregate, for choosing partition counts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(total: int, each: int = BUCKET_BYTES) -> int:
    return max(1, -(-total // each))


def bucketed(docs: DataFrame, n: int) -> DataFrame:
    """Adds ``bucket``: documents dealt evenly by a hash of doc_id and text, even if many share one of the two."""
    return docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and the n + 1 offsets of its rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4)).astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def by_bytes(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in portions of about ``most`` bytes of text; a longer text is one by itself."""
    _, offsets = flat(batch.column("text"))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places of its entries, ascending: one sort, whatever the number of parts."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(part[own[0]]), own


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as delta bytes in planes, compressed: a front-coded sorted run of keys."""
    import zstandard

    delta = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T)
    return len(keys).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    n = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:], max_output_size=max(1, 8 * n)), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_ints(values: np.ndarray, dtype: str) -> bytes:
    """Integers as byte planes, compressed."""
    import zstandard

    values = np.ascontiguousarray(values.astype(dtype))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else values
    return len(values).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_ints(blob: bytes, dtype: str) -> np.ndarray:
    import zstandard

    n, width = int.from_bytes(blob[:4], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:], max_output_size=max(1, width * n)), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def packed_documents(docs: DataFrame, carried: str | None = None, each: int = BUCKET_BYTES) -> DataFrame:
    """bucket, packed: rows of (bucket, doc_id, text) as compressed blobs, one for each bucket and portion of a task's input, so that texts cross a shuffle at half the size.

    carried: a struct column that goes along, as the blob ``rest`` (Arrow, compressed).
    each: bytes of a bucket; a task holds four times as many before it lets go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}
        rest: dict[int, list[pa.Array]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            blobs = [pack_texts(ids, raw) for ids, raw in held.values()]
            columns = {"bucket": pa.array(list(held), pa.int32()), "packed": pa.array(blobs, pa.binary())}
            if carried:
                columns["rest"] = pa.array([pack_structs(rest[b]) for b in held], pa.binary())
            return pa.record_batch(columns)

        for batch in batches:
            data, offsets = flat(batch.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            for i, (bucket, doc_id) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                ids, own = held.setdefault(bucket, ([], []))
                ids.append(doc_id)
                own.append(raw[at[i] : at[i + 1]])
            if carried:
                buckets = batch.column("bucket").to_numpy()
                order = np.argsort(buckets, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1):
                    if len(own):
                        rest.setdefault(int(buckets[own[0]]), []).append(batch.column(carried).take(pa.array(own)))
            size += len(raw)
            if size > 4 * each:
                yield flush()
                held, rest, size = {}, {}, 0
        if held:
            yield flush()

    return docs.select("bucket", "doc_id", "text", *([carried] if carried else [])).mapInArrow(run, "bucket int, packed binary" + (", rest binary" if carried else ""))


def pack_structs(parts: list[pa.Array]) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    whole = pa.concat_arrays(parts)
    with pa.ipc.new_stream(sink, pa.schema([("row", whole.type)])) as out:
        out.write_batch(pa.record_batch({"row": whole}))
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(sink.getvalue())


def unpack_structs(blobs: list[bytes]) -> pa.Array:
    import zstandard

    return pa.concat_arrays([pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(b)).read_all().column("row").combine_chunks() for b in blobs])


def pack_texts(ids: list[int], raw: list[bytes]) -> bytes:
    import zstandard

    head = np.array([len(ids), *ids, *map(len, raw)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(head + b"".join(raw))


def unpack_texts(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ids, offsets (one more than ids) and all bytes of packed documents."""
    import zstandard

    ids, sizes, raw = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for blob in blobs:
        x = zstandard.ZstdDecompressor().decompress(blob)
        n = int.from_bytes(x[:8], "little")
        ids.append(np.frombuffer(x, "<i8", n, 8).astype(np.int64))
        sizes.append(np.frombuffer(x, "<i8", n, 8 + 8 * n).astype(np.int64))
        raw.append(x[8 + 16 * n :])
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64), b"".join(raw)
