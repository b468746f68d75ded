"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the 64-bit hashes of its word
shingles.  Covering LSH finds all pairs of fingerprints within ``radius`` bits, with
no false negatives: every bit position gets a vector of radius + 1 bits, and for each
nonzero vector v a mask keeps the positions whose vector has odd parity with v.
Fewer than radius + 1 differing positions span too little to meet every mask, so
some table agrees on its mask for every such pair.

Only distinct fingerprints enter the tables (exact and fingerprint-equal copies are
one node, the smallest doc_id), so a group of copies of any size is one row.  A
bucket gives a spanning forest of its links, never all pairs; a large bucket is
split by pigeonhole on the positions outside its mask, which loses no pair.

Defined results: a null or empty text, or one without words, has fingerprint zero and
is linked like any other; fewer words than a shingle make one shingle; repeated
doc_ids are rows of one node each; a null doc_id counts as greater than all others, and
a component of such rows alone has a null id; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import checkpoint, mix64, numbered, strings, text_key, unnumbered
from attestra.llm.components import components, forest
from attestra.llm.similarity import SLICES, CellCounts, candidates, each_text, shared_prefixes, signature, similar, total_counts, word_hashes

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a bucket that are compared with one another directly; more are first split.
DIRECT = 2048


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's shingles of lower-cased (A-Z) words."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(found) < words:
        hashes = np.array([hash_of(b" ".join(found), seed)], "<u8")
    else:
        hashes = np.fromiter((hash_of(x, seed) for x in map(b" ".join, zip(*[found[i:] for i in range(words)], strict=False))), "<u8", len(found) - words + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(x, words, seed) for x in strings(part.column("text"))], np.uint64)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": pa.array(fps.view(np.int64))})

    return numbered(docs).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks; bit positions have distinct-as-possible vectors from a fixed shuffle."""
    width = radius + 1
    # positions take nonzero vectors in turn, so that every mask keeps about half of the positions
    vectors = [1 + (i * 11) % ((1 << width) - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (vectors[i] & v).bit_count() % 2) for v in range(1, 1 << width)]


def bucket_links(fps: np.ndarray, fixed: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of distinct fingerprints within ``radius``, enough to connect all that are linked directly.

    fixed: bits on which all agree.  Large groups are split: the free positions fall
    into radius + 1 blocks, a pair within the radius agrees on one of them.
    """
    free = [i for i in range(64) if not fixed >> i & 1]
    if len(fps) <= DIRECT or len(free) <= radius + 1:
        found = []
        for at in range(0, len(fps), 512):
            near = np.bitwise_count(fps[at : at + 512, None] ^ fps[None, :]) <= radius
            x, y = np.nonzero(near)
            own = x + at < y
            found.append((x[own] + at, y[own]))
            if sum(len(f[0]) for f in found) > 1 << 20:
                found = [forest(*(np.concatenate(c) for c in zip(*found, strict=True)))]
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        return forest(a, b) if len(a) else (a, b)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(radius + 1):
        block = sum(1 << i for i in free[k :: radius + 1])
        key = fps & np.uint64(block)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for own in np.split(order, cuts):
            if len(own) > 1:
                a, b = bucket_links(fps[own], fixed | block, radius)
                out_a.append(own[a])
                out_b.append(own[b])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return forest(a, b) if len(a) else (a, b)


def buckets(nodes: DataFrame, radius: int) -> DataFrame:
    """id, fp, t, k: each node in its bucket k of each covering table t."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks(radius))])
    return nodes.select("id", "fp", F.explode(tables).alias("e")).select("id", "fp", "e.t", "e.k")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: links among nodes (id, fp; fp distinct) within ``radius``, enough to keep every component whole."""
    all_masks = masks(radius)
    rows = buckets(nodes, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def linked(part: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            ids, fps, t, k = part
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(k) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [len(t)]])
            a, b = [], []
            for lo in np.flatnonzero(np.diff(bounds) > 1).tolist():
                own = slice(bounds[lo], bounds[lo + 1])
                x, y = bucket_links(fps[own], all_masks[int(t[own][0])], radius)
                a.append(ids[own][x])
                b.append(ids[own][y])
            if a and (a := np.concatenate(a)).size:
                a, b = forest(a, np.concatenate(b))
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy() if c != "fp" else batch.column(c).to_numpy().view(np.uint64) for c in ("id", "fp", "t", "k")))
            t, k = held[-1][2], held[-1][3]
            if (t[0], k[0]) == (t[-1], k[-1]) and len(held) > 1 and (held[0][2][0], held[0][3][0]) == (t[0], k[0]):
                continue  # one bucket still
            whole = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            t, k = whole[2], whole[3]
            cut = int(np.flatnonzero((t == t[-1]) & (k == k[-1]))[0])  # the last bucket may go on
            yield from linked(tuple(c[:cut] for c in whole))
            held = [tuple(c[cut:] for c in whole)]
        if held:
            yield from linked(tuple(np.concatenate(c) for c in zip(*held, strict=True)))

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "t", "k").sortWithinPartitions("t", "k").mapInArrow(run, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links)."""
    prints = checkpoint(fingerprints(docs, words, seed))
    # nodes have numbers of their own: many fingerprints can share the smallest doc_id, null or repeated ones
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("id", F.monotonically_increasing_id()))
    found = components(links(nodes.select("id", "fp"), radius)).withColumnRenamed("id", "_id")
    grouped = nodes.join(found, nodes["id"] == found["_id"], "left").select(F.col("fp").alias("_fp"), "least", F.coalesce("component", "id").alias("group"))
    named = grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("_fp", "component_id")
    out = prints.join(named, prints["fp"] == named["_fp"])
    return unnumbered(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "doc_id", "component_id")


def representatives(docs: DataFrame, words: int = 5, radius: int = RADIUS, reach: int = 8, seed: int = SEED, similarity: float = 0.8) -> DataFrame:
    """One document of each near-duplicate group stays, its columns as they came.

    Two documents are linked if ``similarity`` or more of their ``words``-word shingles
    agree (Jaccard), and a group is what links connect.  Of a group the smallest doc_id
    stays (null last, then by its other columns, so that the choice does not depend on
    how rows arrive); rows of one doc_id with different texts are documents of their own.

    1. Of exact copies one row is left, before anything is compared.
    2. Covering tables of fingerprints over a text's different words, which a few changed
       words move little, give candidates: in each bucket, in one order for all tables,
       a document and the next one, if they are within ``reach`` bits.  So a group of n
       gives n candidates a table, not n squared, and large groups come together.
    3. Signatures confirm the candidates; confirmed ones are links.
    4. ``similarity.candidates`` finds what is left: first each document and the next one
       that shares a rare shingle, so that a large group comes together by as many pairs as
       it has rows, then all pairs of documents not yet connected that may be similar,
       whatever was added, cut or changed.  Sketches of the texts rule out nearly all pairs
       that are just below ``similarity`` before they are made, and none that is not.
    """
    own = checkpoint(distinct_texts(docs), release=True)
    plain = own.select(F.col("_node").alias("node"), F.coalesce(F.col("_row.text").cast("string"), F.lit("")).alias("text"))
    pass_over = checkpoint(plain.mapInArrow(_prints_and_counts(words, seed), "node long, fp long, slice int, counts binary"))
    close = checkpoint(neighbours(pass_over.filter("fp is not null").select(F.col("node").alias("id"), "fp"), radius, reach).distinct())
    links = checkpoint(similar(close, plain, words, similarity), release=True)
    groups = components(links)
    counts = total_counts(pass_over.filter("slice is not null").select("slice", "counts"))
    met = checkpoint(shared_prefixes(plain, counts, words, similarity), release=True)
    for adjacent in (True, False):
        rest = checkpoint(candidates(met, groups, similarity, adjacent, plain, words))
        links = links.unionByName(checkpoint(similar(rest, plain, words, similarity), release=True))
        groups = components(links)
    ranked = own.select(F.col("_node").alias("id"), _rank(docs).alias("rank")).join(groups, "id")
    best = ranked.groupBy("component").agg(F.min_by("id", F.struct("rank", "id")).alias("best"))
    gone = ranked.join(best, "component").filter("id <> best").select(F.col("id").alias("_gone"))
    return own.join(gone, own["_node"] == gone["_gone"], "left_anti").select("_row.*")


def _rank(docs: DataFrame) -> Column:
    """Orders rows, the smallest doc_id first."""
    others = [F.col(f"_row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return F.struct(F.col("_row.doc_id").isNull().alias("none"), F.col("_row.doc_id").alias("doc_id"), (F.to_json(F.struct(*others)) if others else F.lit("")).alias("other"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """_row, _node: one row of each text, the first by doc_id, combined before the shuffle; checkpoint it, as nodes are numbered on the way."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    first = rows.groupBy(text_key(F.col("_row.text")).alias("_sha")).agg(F.min_by("_row", _rank(docs)).alias("_row"))
    return first.select("_row", F.monotonically_increasing_id().alias("_node"))


def neighbours(nodes: DataFrame, radius: int, reach: int) -> DataFrame:
    """a, b: in each bucket of the covering tables each node (id, fp) and the next one, if ``reach`` bits or fewer differ."""
    rows = buckets(nodes, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = tuple(np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, ids, fps = last = tuple(np.concatenate([x[-1:], batch.column(c).to_numpy()]) for x, c in zip(last, ("t", "k", "id", "fp"), strict=True))
            near = (t[1:] == t[:-1]) & (k[1:] == k[:-1]) & (np.bitwise_count((fps[1:] ^ fps[:-1]).view(np.uint64)) <= reach)
            a, b = ids[:-1][near], ids[1:][near]
            yield pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("o", F.xxhash64("id")).repartition(n, "t", "k").sortWithinPartitions("t", "k", "o").select("id", "fp", "t", "k").mapInArrow(run, "a long, b long")


def _prints_and_counts(words: int, seed: int):
    """One pass over the texts: fingerprints of their different words, and at its end the counts of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = CellCounts()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, fps = batch.slice(at, 512), []
                for text in each_text(part):
                    own = word_hashes(text)
                    total.add(signature(own, words))
                    fps.append(majority(mix64(np.unique(own) ^ np.uint64(seed))))
                n = part.num_rows
                yield pa.record_batch({"node": part.column("node"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "slice": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.binary())})
        yield pa.record_batch({"node": pa.nulls(SLICES, pa.int64()), "fp": pa.nulls(SLICES, pa.int64()), "slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array(total.slices(), pa.binary())})

    return run
