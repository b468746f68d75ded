"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity``; only longer documents are
cut.  What packing needs to know is the histogram of piece lengths, which has at
most ``capacity`` rows however many documents there are.  On it, minimum bin slack
runs: the longest length left opens a sequence, a bitset subset-sum dynamic
programme over the lengths that are left finds the fullest combination that joins
it, and the combination is taken as often as the histogram allows before the next
one is sought.  Pieces then get their places by rank within their length.

Ranks are taken in two levels (bucket, then bucket offsets), so that a length that
a third of all pieces have is never in one task.

Defined results: a null or empty text is one piece, the separator alone; a
document of exactly ``capacity`` ids with separator is one piece; pieces of equal
length are interchangeable and go by bucket, doc_id and piece; no documents give
no sequences.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from struct import pack as packed

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import bucket_count, by_bytes, checkpoint, strings, texts

#: Words, and runs of letters or signs within words, kept in a worker's memos before one is emptied.
MEMO_WORDS, MEMO_PARTS = 200_000, 300_000
#: White space to Python alone, and a letter whose lower case depends on its neighbours.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\u03a3")
#: Pieces in one bucket of the two-level ranks, and the fewest buckets.
BUCKET_PIECES, BUCKETS = 20_000, 64


# The normaliser, pre-tokenizer and word ending for which words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
WORD_END = "</w>"
#: Runs that the library encodes in one call.
JOINED = 512


class WordBPE:
    """Ids of a BPE from ``tokenizers``, word by word with a bounded memo where that is sound.

    With the normaliser and pre-tokenizer above, a word's ids do not depend on its
    neighbours, and each new run goes through the library itself.  A tokenizer of any
    other kind gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        model = own["model"]
        self.by_word = own["normalizer"] == NORMALIZER and own["pre_tokenizer"] == PRE_TOKENIZER and own.get("post_processor") is None and (model["type"], model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", WORD_END, None)
        if self.by_word:
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(WORD_END)]] = True
        self.parts = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.runs = re.compile(r"[.,](?:(?=_|[^\w\s])|(?<=[^\w\s][.,])|(?<=_[.,]))")
        self.memo: dict[str, bytes] = {}
        self.part_memo: dict[str, bytes] = {}

    def whole(self, batch: list[str]) -> list[bytes]:
        return [packed(f"<{len(x.ids)}I", *x.ids) for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def each_run(self, runs: list[str]) -> list[bytes]:
        """The ids of runs of one class: encoded many in one text, and cut where the word-ending tokens are."""
        out: list[bytes] = []
        for at in range(0, len(runs), JOINED):
            own = runs[at : at + JOINED]
            (raw,) = self.whole([" ".join(own)])
            cuts = (4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4).tolist()
            out += [raw[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)] if len(cuts) == len(own) else self.whole(own)
        return out

    def learn(self, words: list[str]) -> None:
        """Words without an apostrophe, outside which the pattern is runs of one class, are put together from their runs.

        A word that changes its length in lower case could change its runs too, and goes whole.
        """
        memo, parts, simple, other = self.memo, self.part_memo, [], []
        for w in words:
            x = w.lower()
            if "'" in x or "<|" in x or len(w) != len(x):
                other.append(w)
            else:
                simple.append((w, self.parts.findall(x)))
        if new := list({p for _, x in simple for p in x if p not in parts}):
            parts.update(zip(new, self.each_run(new), strict=True))
        for w, x in simple:
            memo[w] = parts[x[0]] if len(x) == 1 else b"".join([parts[p] for p in x])
        if other:
            memo.update(zip(other, self.whole(other), strict=True))

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(batch)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        if len(self.part_memo) > MEMO_PARTS:
            self.part_memo.clear()
        cut = [self.words(text) for text in batch]
        if unknown := set().union(*[words for words in cut if words]) - memo.keys():
            self.learn(list(unknown))
        return [self.whole([text])[0] if words is None else b"".join(map(memo.__getitem__, words)) for text, words in zip(batch, cut, strict=True)]

    def words(self, text: str) -> list[str] | None:
        """Lower-case words; commas and full stops, where they stand alone, are words of their own, which leaves fewer distinct ones.  None: only the library can tell."""
        lower = text.lower()
        if len(lower) != len(text) or any(x in text for x in ODD) or not text.isascii() and not unicodedata.is_normalized("NFC", text):
            return None
        if not self.runs.search(lower):
            lower = lower.replace(",", " , ").replace(".", " . ")
        return lower.split()


_loaded: dict[str, WordBPE] = {}


def _codec(path: str) -> WordBPE:
    """One codec for each worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids, then the separator, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _codec(path)
        end = int(separator).to_bytes(4, "little")
        for batch in batches:
            for part in by_bytes(batch):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), bpe.encode_batch(strings(part.column("text"))), strict=True):
                    ids += end
                    rows += [(doc_id, k, k * capacity, len(x) // 4, zlib.crc32(x)) for k, i in enumerate(range(0, len(ids), 4 * capacity)) if (x := ids[i : i + 4 * capacity])]
                yield pa.record_batch(
                    {n: pa.array([r[i] for r in rows], pa.int32() if n == "piece" else pa.int64()) for i, n in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))}
                )

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, each used at most its count, whose sum is the largest up to ``room``; longer lengths first."""
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        layers.append((length, reach))
        have, step = min(counts[length], room // length), 1
        while have:  # bounded use in binary steps
            take = min(step, have)
            reach |= (reach << (length * take)) & mask
            have, step = have - take, step * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        used = 0
        while not before >> total & 1:
            total, used = total - length, used + 1
        out += [length] * used
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of one sequence): the whole histogram packed, fullest combinations first."""
    left = {k: v for k, v in histogram.items() if v > 0}
    plan: list[tuple[int, list[int]]] = []
    while left:
        longest = max(left)
        left[longest] -= 1
        lengths = [longest, *fullest({k: v for k, v in left.items() if v}, capacity - longest)]
        left[longest] += 1
        need = {x: lengths.count(x) for x in set(lengths)}
        times = min(left[x] // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
        plan.append((times, lengths))
    return plan


def slots(plan: list[tuple[int, list[int]]]) -> dict[int, list[tuple[int, int, int]]]:
    """For each length the places of its pieces by rank: (first rank, first sequence, offset in a sequence)."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for x in lengths:
            out.setdefault(x, []).append((rank.get(x, 0), sequence, offset))
            rank[x], offset = rank.get(x, 0) + times, offset + x
        sequence += times
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows of doc_id, piece, length, ..."""
    pieces = checkpoint(pieces)
    n = max(BUCKETS, bucket_count(pieces.count(), BUCKET_PIECES))
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    counts = keyed.groupBy("length", "_bucket").count()
    histogram = dict(counts.groupBy("length").agg(F.sum("count")).collect())  # at most `capacity` rows
    places = slots(minimum_bin_slack(histogram, capacity))
    offsets = counts.withColumn(
        "_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1
    ranked = keyed.withColumn("_in", rank).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    tables = {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in places.items()}  # bounded by the plan

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for x in np.unique(length).tolist():
                own, (first, start, inside) = length == x, tables[x]
                k = np.searchsorted(first, at[own], "right") - 1
                sequence[own], offset[own] = start[k] + at[own] - first[k], inside[k]
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    return ranked.select(*[f.name for f in fields], "_rank").mapInArrow(place, schema)
