"""Benchmark decontamination by suffix arrays over shards of the training texts.

A shard is some megabytes of a task's own texts, so no text is shuffled.  Its words become
numbers of the benchmark's vocabulary (0: a word that no item has), its suffixes that
begin with enough known words are sorted as deep as a window, and deeper where a test
suffix went that far.  Every suffix of every item is then found by binary search, word
by word and all of them at once: the interval at the depth of a window holds all its
occurrences, the depth where the interval ends is the longest verbatim match.  Words are
numbered by a hash; the words of what was found are compared byte by byte.

Items go to the workers in blocks of bounded size, whatever the size of the benchmark; a
text passes all blocks before it leaves its stage.

Defined results: a null text (of a document or an item) has no words; an item without
words takes no part; an item of fewer words than a window is one window; rows of one
item_id are one item, a null item_id is written as an empty string; documents are judged
row by row, whatever their doc_ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestra.llm.common import by_bytes, flat, mix64

#: Bytes of text of a shard, and of items sent to the workers at once.
SHARD, BLOCK = 8 << 20, 4 << 20
#: Suffix starts of one array; a longer text has several, which overlap by the longest item.
STARTS = 2 << 20
#: Words: digits, letters (A-Z as a-z) and all that is not ASCII; 0 stands for any other byte.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def words(raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """``raw`` with other bytes than those of words as 0, and where its words start and end."""
    text = raw.translate(WORD)
    known = np.frombuffer(text, np.uint8) != 0
    edge = np.flatnonzero(np.diff(known, prepend=False, append=False))
    return text, edge[::2], edge[1::2]


def keys(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of each word, eight bytes at a time; different for different words of up to eight bytes."""
    at = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), strides=(1,))
    out = at[starts] & _MASK[np.minimum(sizes, 8)]
    done, rest = 8, np.flatnonzero(sizes > 8)
    while len(rest):
        out[rest] = mix64(out[rest]) ^ (at[starts[rest] + done] & _MASK[np.minimum(sizes[rest] - done, 8)])
        done += 8
        rest = rest[sizes[rest] > done]
    return out


def places(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class Suite:
    """A block of items: vocabulary, words as numbers with a 0 after each item, and the test suffixes."""

    names: np.ndarray
    vocabulary: np.ndarray
    spelled: tuple[bytes, np.ndarray, np.ndarray]
    longest_word: int
    ids: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    window: np.ndarray
    longest: int
    shortest: int

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], size: int) -> Suite | None:
        raw = b"\0".join(t for _, t in items)
        text, start, end = words(raw)
        if not len(start):
            return None
        sizes = end - start
        vocabulary, first, number = np.unique(keys(text, start, sizes), return_index=True, return_inverse=True)
        owner = np.searchsorted(np.cumsum([len(t) + 1 for _, t in items]), start, "right")
        at = np.arange(len(start)) + owner  # one 0 after each item, also after those without words
        ids = np.zeros(len(start) + len(items) + 1, np.int32)
        ids[at] = number.ravel() + 1
        count = np.bincount(owner, minlength=len(items))[owner]
        left = count - places(np.bincount(owner)[np.unique(owner)])
        window = np.where(count < size, np.where(left == count, count, 0), np.where(left >= size, size, 0))
        return cls(np.array([n for n, _ in items], object), vocabulary, (text, start[first], sizes[first]), int(sizes.max()), ids, at, owner, window.astype(np.int32), int(count.max()), int(window[window > 0].min()))


@dataclass
class Found:
    """Of a shard: its covered words, which windows (as groups of test suffixes) are in which documents, and each test suffix's longest match (from the shortest window on) with its first place."""

    covered: np.ndarray
    length: np.ndarray
    place: np.ndarray
    documents: list[tuple[int, int]] = field(default_factory=list)
    groups: list[np.ndarray] = field(default_factory=list)


class SuffixArray:
    """Suffixes of ``ids`` that start at ``at``, sorted by their first ``depth`` words; deeper within intervals on demand."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, bits: int, depth: int):
        self.ids, self.bits, self.each = ids, bits, max(1, 63 // bits)
        key = self._key(at)
        order = np.argsort(key, kind="stable")
        self.order, key = at[order], key[order]
        self.group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.depth = self.each
        while self.depth < depth:
            self.deepen(np.ones(len(at), bool))

    def _key(self, at: np.ndarray) -> np.ndarray:
        """The next ``each`` words from ``at`` as one number; an unknown word ends a suffix, what follows it does not count."""
        out, on = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for j in range(self.each):
            word = self.ids[np.minimum(at + j, len(self.ids) - 1)].astype(np.int64) * on
            on &= word > 0
            out = out << self.bits | word
        return out

    def deepen(self, where: np.ndarray) -> None:
        """Sort equal suffixes among those of ``where`` by their next words."""
        same = np.zeros(len(self.order), bool)
        equal = self.group[1:] == self.group[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        open_ = np.flatnonzero(same & where)
        if len(open_):
            key, group = self._key(self.order[open_] + self.depth), self.group[open_]
            by = np.lexsort((key, group))
            self.order[open_], key = self.order[open_][by], key[by]
            fresh = np.zeros(len(self.order), bool)
            fresh[1:] = ~equal
            fresh[open_[1:]] |= key[1:] != key[:-1]
            self.group = np.cumsum(fresh)
        self.depth += self.each

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """The first place in each interval whose suffix has no smaller word at ``depth``."""
        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            less = self.ids[self.order[mid] + depth] < word[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low

    def narrowed(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = self._bound(low, high, depth, word)
        return low, self._bound(low, high, depth, word + 1)


def _search(suite: Suite, ids: np.ndarray, owner: np.ndarray, rank: np.ndarray, found: Found, at: np.ndarray) -> None:
    """Every test suffix against the suffixes of ``ids`` that start at ``at``."""
    array = SuffixArray(ids, at, int(len(suite.vocabulary)).bit_length(), int(suite.window.max()))
    bounds = np.searchsorted(ids[array.order], np.arange(len(suite.vocabulary) + 2))
    alive = np.arange(len(suite.starts))
    word = suite.ids[suite.starts]
    low, high = bounds[word], bounds[word + 1]
    at_window: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
    reach, first, last = (np.zeros(len(suite.starts), np.int64) for _ in range(3))
    depth = 0
    while True:
        on = low < high
        alive, low, high = alive[on], low[on], high[on]
        if not len(alive):
            break
        depth += 1
        reach[alive], first[alive], last[alive] = depth, low, high
        if (full := suite.window[alive] == depth).any():
            at_window.append((alive[full], low[full], high[full], depth))
        word = suite.ids[suite.starts[alive] + depth]
        more = word > 0
        alive, low, high, word = alive[more], low[more], high[more], word[more]
        if depth >= array.depth and len(alive):
            reached = np.zeros(len(array.order) + 1, np.int64)
            np.add.at(reached, low, 1)
            np.add.at(reached, high, -1)
            array.deepen(np.cumsum(reached)[:-1] > 0)
        low, high = array.narrowed(low, high, depth, word)
    if (test := np.flatnonzero((reach >= suite.shortest) & (reach >= found.length))).size:
        ends, own = np.unique(np.stack([first[test], last[test]]), axis=1, return_inverse=True)  # equal matches have one interval
        least = np.minimum.reduceat(np.append(rank[owner[array.order]] * len(ids) + array.order, 0), ends.T.ravel())[::2][own.ravel()]
        found.place[test] = np.where(reach[test] > found.length[test], least, np.minimum(least, found.place[test]))
        found.length[test] = reach[test]
    for test, low, high, size in at_window:
        _, one, group = np.unique(low, return_index=True, return_inverse=True)  # equal windows have one interval
        count = high[one] - low[one]
        occurs = array.order[np.repeat(low[one], count) + places(count)]
        edge = np.bincount(occurs, minlength=len(ids)) - np.bincount(occurs + size, minlength=len(ids))[: len(ids)]
        found.covered |= np.cumsum(edge) > 0
        document, own = np.divmod(np.unique(owner[occurs] * len(one) + np.repeat(np.arange(len(one)), count)), len(one))
        by = np.argsort(group.ravel(), kind="stable")
        members = np.split(suite.item[test[by]], np.cumsum(np.bincount(group.ravel()))[:-1])
        found.documents += zip(document.tolist(), (own + len(found.groups)).tolist(), strict=True)
        found.groups += [np.unique(m) for m in members]


def search(suite: Suite, raw: bytes, ends: np.ndarray, rank: np.ndarray | None = None) -> tuple[Found, np.ndarray, np.ndarray]:
    """What a shard holds of the items, the document of each place (a word, or the 0 after a document), and where documents start.

    ``raw``: texts with a 0 after each; ``ends``: where those are; ``rank``: the documents'
    order, in which a match's first place is the first (else as they lie).
    """
    rank = np.arange(len(ends) + 1) if rank is None else np.append(rank, len(ends))
    text, start, end = words(raw)
    sizes = end - start
    owner = np.searchsorted(ends, start, "right")
    at = np.arange(len(start)) + owner
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ends)) + 1)])
    ids = np.zeros(len(start) + len(ends) + suite.longest + 64, np.int32)
    short = np.flatnonzero(sizes <= suite.longest_word)
    key = keys(text, start[short], sizes[short])
    number = np.minimum(np.searchsorted(suite.vocabulary, key), len(suite.vocabulary) - 1)
    known = suite.vocabulary[number] == key
    ids[at[short[known]]] = number[known] + 1
    place = np.repeat(np.arange(len(ends) + 1), np.diff(np.append(first, len(ids))))
    word_of = np.zeros(len(ids), np.int64)
    word_of[at] = np.arange(len(start))
    while True:
        index = np.arange(len(ids))
        ahead = np.minimum.accumulate(np.where(ids == 0, index, len(ids))[::-1])[::-1] - index
        begins = np.flatnonzero(ahead >= suite.shortest)
        found = Found(np.zeros(len(ids), bool), np.zeros(len(suite.starts), np.int32), np.zeros(len(suite.starts), np.int64))
        for i in range(0, len(begins), STARTS):
            _search(suite, ids, place, rank, found, begins[i : i + STARTS])
        found.place %= len(ids)
        # an exact check of the words found; one that only has the hash of a known word is unknown
        hit = np.flatnonzero(found.covered)
        own, spelled, their, size = word_of[hit], ids[hit] - 1, suite.spelled[1], suite.spelled[2]
        wrong = sizes[own] != size[spelled]
        hit, own, spelled = hit[~wrong], own[~wrong], spelled[~wrong]
        step = places(sizes[own])
        a, b = np.frombuffer(text, np.uint8), np.frombuffer(suite.spelled[0], np.uint8)
        differs = a[np.repeat(start[own], sizes[own]) + step] != b[np.repeat(their[spelled], sizes[own]) + step]
        bad = np.unique(np.repeat(hit, sizes[own])[differs])
        if not wrong.any() and not len(bad):
            return found, place, first
        ids[np.concatenate([np.flatnonzero(found.covered)[wrong], bad])] = 0


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """Portions of rows, their texts with a 0 after each, and where those are."""
    for batch in batches:
        for part in by_bytes(batch, SHARD):
            data, offsets = flat(part.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            yield part, b"".join(raw[a:b] + b"\0" for a, b in zip(at, at[1:], strict=False)), offsets[1:] + np.arange(part.num_rows)


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[str, bytes]]]:
    """All items, in lists of about ``block`` bytes; a longer item is one by itself."""
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).distinct()
    total = item.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block)) if total > block else 1
    for i in range(n):
        own = item.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else item
        yield sorted((r["item_id"], r["text"].encode()) for r in own.collect())


def contamination(docs: DataFrame, benchmark: DataFrame, carried: list[str] | None = None, window: int = 10, block: int = BLOCK) -> DataFrame:
    """The columns ``carried`` (all, if None) of each document, with n_words, hits (maximal runs of words inside a window of an item) and items (ids with a window here, sorted)."""
    carried = docs.columns if carried is None else carried
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.struct(*carried).alias("row"), text.alias("text"), F.lit(None).cast("struct<n_words:long,hits:array<struct<start:int,length:int>>,items:array<string>>").alias("seen"))
    for items in _blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # some BLOCK bytes
        out = out.mapInArrow(_pass(shared, window), out.schema)
    kept = [F.col("row")[c].alias(c) for c in carried if c not in ("n_words", "hits", "items")]
    return out.select(*kept, "seen.*")


def _pass(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suite = Suite.of(shared.value, window)
        empty = np.zeros(0, np.int64)
        for part, raw, ends in _shards(batches):
            if suite is None:
                first = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(ends, words(raw)[1], "right"), minlength=len(ends)) + 1)])
                covered, of = np.zeros(int(first[-1]), bool), {}
            else:
                found, _, first = search(suite, raw, ends)
                covered, of = found.covered[: first[-1]], {}
                for d, g in found.documents:
                    of.setdefault(d, []).append(found.groups[g])
            before = part.column("seen")
            for d in range(part.num_rows) if before.null_count < part.num_rows else ():
                for h in (seen := before[d].as_py())["hits"]:
                    covered[first[d] + h["start"] : first[d] + h["start"] + h["length"]] = True
            edge = np.flatnonzero(np.diff(covered, prepend=False, append=False))
            begin, stop = edge[::2], edge[1::2]
            owner = np.searchsorted(first, begin, "right") - 1
            named = []
            for d in range(part.num_rows):
                own = {suite.names[i] for i in np.unique(np.concatenate(of.get(d, [empty])))} if d in of else set()
                if before.null_count < part.num_rows:
                    own |= set(before[d].as_py()["items"])
                named.append(sorted(own))
            spans = pa.StructArray.from_arrays([pa.array((begin - first[owner]).astype(np.int32)), pa.array((stop - begin).astype(np.int32))], ["start", "length"])
            cuts = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            hits = pa.ListArray.from_arrays(pa.array(cuts), spans)
            seen = pa.StructArray.from_arrays([pa.array(np.diff(first) - 1), hits, pa.array(named, pa.list_(pa.string()))], ["n_words", "hits", "items"])
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), seen], ["row", "text", "seen"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    whole = docs.select(F.struct("*").alias("whole"), "text")
    return contamination(whole, benchmark, ["whole"], window).filter(F.size("hits") == 0).select("whole.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block: int = BLOCK) -> DataFrame:
    """item_id, item_word, n_words, doc_id, doc_word: the longest verbatim match of each test suffix that no longer one of the item holds, and the first place that has it.

    Matches shorter than the block's shortest window are not looked for.  Of places with
    equally long matches the smallest doc_id counts (null after all others), then the
    first word.
    """
    own, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), None

    def search_of(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            suite = Suite.of(shared.value, window)
            for part, raw, ends in _shards(batches) if suite is not None else ():
                order = np.array(pc.array_sort_indices(part.column("doc_id"), null_placement="at_end")) if part.num_rows else np.zeros(0, np.int64)
                found, place, first = search(suite, raw, ends, np.argsort(order))
                item_word = places(np.bincount(suite.item)[np.unique(suite.item)])
                before = np.where(item_word > 0, np.roll(found.length, 1), 0)
                test = np.flatnonzero((found.length >= suite.shortest) & (found.length >= before))
                doc = place[found.place[test]]
                yield pa.record_batch({
                    "item_id": pa.array(suite.names[suite.item[test]], pa.string()), "item_word": pa.array(item_word[test].astype(np.int32)), "n_words": pa.array(found.length[test]),
                    "doc_id": part.column("doc_id").take(pa.array(doc)), "doc_word": pa.array((found.place[test] - first[doc]).astype(np.int32)),
                })

        return run

    for items in _blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # some BLOCK bytes
        found = own.mapInArrow(search_of(shared), StructType.fromDDL("item_id string, item_word int, n_words int, doc_id long, doc_word int"))
        out = found if out is None else out.union(found)
    best = F.max(F.struct("n_words", (-F.col("doc_id")).alias("d"), (-F.col("doc_word")).alias("w"))).alias("best")
    return out.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", F.col("best.n_words").alias("n_words"), (-F.col("best.d")).alias("doc_id"), (-F.col("best.w")).alias("doc_word"))
