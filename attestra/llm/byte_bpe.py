"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern.  Tier one is a minimal
perfect hash over the vocabulary's byte strings: a pre-token that is in the
vocabulary whole costs one probe.  Tier two takes the rest: the bytes form a
doubly linked list, a heap holds the mergeable neighbours by rank and place, and
the lowest rank merges first.  Whole-word results are kept in a bounded memo.

Narrow: no shuffle, texts stream through Arrow batches.  Defined results: a null
or empty text has no ids and decodes to nothing; ids are those of ``tiktoken``'s
``encode_ordinary``; columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attestra.llm.common import mix64, strings, texts

#: Words and pre-tokens kept in a worker's memos before one is emptied.
MEMO_WORDS, MEMO_PIECES = 250_000, 1_000_000


class PerfectHash:
    """A minimal perfect hash from n byte strings to 0..n-1 by hash and displace.

    Keys fall into about n/4 groups; the largest group first, each gets the first
    displacement that sends its keys to free places, and groups of one key take the
    places that are left.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.groups = len(keys), max(1, len(keys) // 4)
        h = self.hashes(keys)
        group = (h % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        first = np.searchsorted(group[order], np.arange(self.groups + 1))
        sizes = np.diff(first)
        self.shift = np.zeros(self.groups, np.int64)
        taken = np.zeros(self.n, bool)
        tries = np.arange(1, 129, dtype=np.uint64)
        for g in np.argsort(-sizes, kind="stable"):
            if sizes[g] < 2:
                break
            own, at = h[order[first[g] : first[g + 1]]], np.uint64(0)
            while True:
                places = self.place(own[None, :], (tries + at)[:, None])
                free = ~taken[places].any(axis=1)
                if sizes[g] > 1:
                    ranked = np.sort(places, axis=1)
                    free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if free.any():
                    hit = int(free.argmax())
                    self.shift[g] = int(tries[hit] + at)
                    taken[places[hit]] = True
                    break
                at += np.uint64(len(tries))
        alone = np.flatnonzero(sizes == 1)
        self.shift[alone] = -1 - np.flatnonzero(~taken)[: len(alone)]
        self.keys: list[bytes] = [b""] * self.n
        self.index = np.zeros(self.n, np.int64)
        for i, slot in enumerate(self.slots(h).tolist()):
            self.keys[slot], self.index[slot] = keys[i], i

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def place(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix64(h + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        shift = self.shift[(h % np.uint64(self.groups)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self.place(h, shift.astype(np.uint64)))

    def find(self, keys: list[bytes]) -> list[int]:
        """The index of each key as it was given, or -1."""
        if not keys or not self.n:
            return [-1] * len(keys)
        slots = self.slots(self.hashes(keys))
        return [i if self.keys[s] == k else -1 for k, s, i in zip(keys, slots.tolist(), self.index[slots].tolist(), strict=True)]


class ByteBPE:
    """Encoder and decoder for one vocabulary of ranks and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        rows = [line.split() for line in open(path, "rb") if line.strip()]
        self.vocabulary = [base64.b64decode(a) for a, _ in rows]
        self.ranks = [int(b) for _, b in rows]
        self.hash = PerfectHash(self.vocabulary)
        self.bytes_of = dict(zip(self.ranks, self.vocabulary, strict=True))
        self.high_rank = {k: r << 64 for k, r in zip(self.vocabulary, self.ranks, strict=True)}  # for pairs inside tier two
        self.pattern = regex.compile(pattern)
        self.loose = regex.compile(r"\s\s")
        self.memo: dict[str, bytes] = {}
        self.piece_memo: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Tier two: merge by rank with a heap over linked bytes.

        A heap entry packs rank, start and end of a pair; it is stale once a side of
        the pair has merged otherwise.
        """
        rank, n = self.high_rank.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = after[:]
        heap = [r | i << 32 | i + 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, stop = top >> 32 & 0xFFFFFFFF, top & 0xFFFFFFFF
            j = after[i]
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                e = end[k]
                if (r := rank(piece[i:e])) is not None:
                    heappush(heap, r | i << 32 | e)
            if (p := before[i]) >= 0 and (r := rank(piece[p:stop])) is not None:
                heappush(heap, r | p << 32 | stop)
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : end[i]]) >> 64)
            i = after[i]
        return out

    def pieces(self, found: list[str]) -> list[bytes]:
        """The ids of each pre-token: tier one, then tier two for the misses."""
        raw = [x.encode() for x in found]
        return [pack("<I", self.ranks[i]) if i >= 0 else pack(f"<{len(m := self.merged(k))}I", *m) for k, i in zip(raw, self.hash.find(raw), strict=True)]

    def words(self, text: str) -> list[str]:
        """Cuts where pre-tokens cannot cross: before a single space between two other characters."""
        if self.loose.search(text) or not text or text[0].isspace() or text[-1].isspace():
            return self.pattern.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        memo, known = self.memo, self.piece_memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        if len(known) > MEMO_PIECES:
            known.clear()
        cut = [self.words(x) for x in batch]
        new = {w for words in cut for w in words if w not in memo}
        split = {w: self.pattern.findall(w) for w in new}
        if found := list({p for x in split.values() for p in x if p not in known}):
            known.update(zip(found, self.pieces(found), strict=True))
        for w, parts in split.items():
            memo[w] = b"".join([known[p] for p in parts])
        return [b"".join([memo[w] for w in words]) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


_loaded: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each worker process and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def _portions(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[list[int], list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column("doc_id").to_pylist(), strings(part.column("text"))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) of every document's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for doc_ids, batch in _portions(batches):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode_batch(batch)]
            yield pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary): the bytes that the ids stand for; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            data = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "decoded": pa.array(data, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of encoding and decoding in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for doc_ids, batch in _portions(batches):
            ids = bpe.encode_batch(batch)
            yield pa.record_batch(
                {
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                }
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
