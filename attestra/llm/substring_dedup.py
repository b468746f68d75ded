"""Exact substring deduplication by a sparse suffix array and a common-prefix-aware merge sort.

Every byte of a document that a ``LENGTH``-byte string covers which also starts in a
document of smaller id is removed.  To sort every suffix of a corpus would move many
times its size, so the suffix array is sparse:

* Each string of ``LENGTH`` bytes has an anchor, the leftmost of its GRAM-byte grams
  with the smallest hash.  The anchor depends on the string alone, so equal strings
  have equal anchors at equal offsets, and comparing the suffixes that start at
  anchors (with what stands before them) finds every equal pair.  About 7 % of all
  positions are anchors.
* As in prefix-doubling string sorters, a round of fingerprints comes first: buckets
  of documents send sorted runs of anchor hashes, and learn which occur in two
  documents or more.  Only those suffixes are exchanged.
* A bucket sorts its suffixes, joins equal ones, and sends front-coded runs to the
  range of the splitters they fall into.  A range merges its runs with a loser tree
  whose players carry their common prefix with the last winner: unequal prefixes
  decide without looking at a byte, equal ones are compared from there on.  The
  merged common prefixes also mark the groups with one anchor gram.
* In a group the strings are matched exactly, and each run gets back, for each of its
  suffixes, how far the match with smaller documents reaches to either side.

A gram of very many documents (``HOT``) would make one group large.  Its strings are
exchanged whole instead, one suffix each, joined per bucket and spread by their own
content, so nothing is ever gathered per gram.

Defined results: a null or empty text, or one shorter than ``LENGTH``, keeps all its
bytes; rows that share a doc_id do not remove one another's bytes, and a null doc_id
counts as one that is greater than all others; columns besides doc_id and text are not
read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import BUCKET_BYTES, NO_ID, bucket_count, bucketed, by_part, checkpoint, mix64, numbered, pack_ints, pack_sorted, packed_documents, text_bytes, unnumbered, unpack_ints, unpack_sorted, unpack_structs, unpack_texts

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
#: Documents of one anchor gram from which its strings are exchanged whole.
HOT = 20_000
#: Suffixes that the splitters are picked from, at least (more ranges take more), and bytes of text treated at a time.
SAMPLE, CHUNK = 8192, 1 << 20
#: Runs that one loser tree merges.
FAN_IN = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def anchors(a: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For bytes ``a`` of segments that end at ``ends``: anchor positions, the first and last start of the strings that each serves, and the anchors' hashes."""
    n, none = len(a), np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    h1 = _TABLE[a]
    h2 = h1[:-1] * _power(1) + h1[1:]
    h4 = h2[:-2] * _power(2) + h2[2:]
    h8 = h4[:-4] * _power(4) + h4[4:]
    h16 = h8[:-8] * _power(8) + h8[8:]
    gram = mix64(h16[: n - GRAM + 1] * _power(8) + h8[16 : n - GRAM + 17])
    low = np.uint64(0xFFFFFF)
    key = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)  # hash, then place: the leftmost of the smallest
    for step in (1, 2, 4, 8):
        key = np.minimum(key[:-step], key[step:])
    first = np.minimum(key[: n - LENGTH + 1], key[WINDOW - 16 : WINDOW - 16 + n - LENGTH + 1])
    sizes = np.diff(ends, prepend=0)
    start = np.flatnonzero(np.repeat(ends, sizes)[: n - LENGTH + 1] - np.arange(n - LENGTH + 1) >= LENGTH)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    at = (first[start] & low).astype(np.int64)
    new = np.flatnonzero((np.diff(at) != 0) | (np.diff(start) != 1)) + 1
    lo, hi = np.concatenate([[0], new]), np.concatenate([new - 1, [len(at) - 1]])
    return at[lo], start[lo], start[hi], gram[at[lo]]


class Bucket:
    """A bucket's documents in an order that does not depend on how rows arrive."""

    def __init__(self, group: pa.Table):
        ids, offsets, self.raw = unpack_texts(group.column("packed").to_pylist())
        text = lambda i: self.raw[offsets[i] : offsets[i + 1]]
        order = np.argsort(ids, kind="stable").tolist()
        if len(np.unique(ids)) < len(ids):
            order.sort(key=lambda i: (ids[i], text(i)))
        self.order, self.offsets, self.ids = order, offsets, ids

    def chunks(self) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """Text bytes, ends of their segments, the segments' documents (by place in the order) and offsets in these.

        A document longer than a chunk comes in segments that overlap by LENGTH - 1 bytes,
        so that each string is in one of them.
        """
        parts, held, docs, starts = [], 0, [], []
        for place, i in enumerate(self.order):
            for at in range(self.offsets[i], max(self.offsets[i] + 1, self.offsets[i + 1] - LENGTH + 1), CHUNK):
                parts.append(self.raw[at : min(self.offsets[i + 1], at + CHUNK + LENGTH - 1)])
                docs.append(place)
                starts.append(at - self.offsets[i])
                held += len(parts[-1])
                if held >= CHUNK:
                    yield b"".join(parts), np.cumsum([len(p) for p in parts]), np.array(docs), np.array(starts)
                    parts, held, docs, starts = [], 0, [], []
        if parts:
            yield b"".join(parts), np.cumsum([len(p) for p in parts]), np.array(docs), np.array(starts)


def _squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def _expand(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


_RUN = {"kind": pa.int32(), "part": pa.int32(), "bucket": pa.int32(), "a": pa.binary(), "b": pa.binary()}
_RUN_SCHEMA = "kind int, part int, bucket int, a binary, b binary"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(_RUN.items())})


# --- fingerprints


def _prints(parts: int, buckets: int):
    wanted = max(SAMPLE, 4 * parts)  # strings of the sample, a few for each range

    def run(group: pa.Table) -> pa.Table:
        number, own = group.column("bucket")[0].as_py(), Bucket(group)
        grams, counts, sample = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for raw, ends, docs, _ in own.chunks():
            at, _, _, h = anchors(np.frombuffer(raw, np.uint8), ends)
            if not len(at):
                continue
            doc = docs[np.searchsorted(ends, at, "right")]
            # each gram once a document; a document in two chunks may count twice, which only makes a candidate
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            found, n = np.unique(h[fresh], return_counts=True)
            both = np.concatenate([grams, found])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([counts, n])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            grams, counts = both[first], np.add.reduceat(n, first)
            if mix64(np.array([number], np.uint64))[0] % np.uint64(max(1, buckets // wanted)) == 0:
                every = max(1, len(at) * buckets * (len(own.raw) // CHUNK + 1) // wanted)
                sample += [raw[p : p + GRAM] for p in at[::every].tolist()]
        rows = [(1, 0, number, b"".join(sample), b"")]
        part = (grams % np.uint64(parts)).astype(np.int64)
        for r, mine in by_part(part):
            rows.append((0, r, number, pack_sorted(grams[mine] >> np.uint64(16)), pack_ints(np.minimum(counts[mine], 65535), "<u2")))
        return _table(rows)

    return run


def _repeated(hot: int):
    """0: in one document alone, 1: repeated, 2: in ``hot`` documents or more."""

    def answer(group: pa.Table) -> pa.Table:
        part, buckets = group.column("part")[0].as_py(), group.column("bucket").to_pylist()
        runs = [unpack_sorted(x) for x in group.column("a").to_pylist()]
        counts = np.concatenate([unpack_ints(x, "<u2") for x in group.column("b").to_pylist()]).astype(np.int64)
        keys = np.concatenate(runs)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts, first)
        level = (total > 1).astype(np.uint8) + (total >= hot)
        keys = keys[first]
        return _table([(0, part, b, pack_ints(level[np.searchsorted(keys, x)], "<u1"), b"") for b, x in zip(buckets, runs, strict=True)])

    return answer


# --- suffixes


def front_coded(strings: list[bytes]) -> bytes:
    """Sorted strings as common prefixes, lengths of the rest, and the rests."""
    common, rest, before = bytearray(), [], b""
    for s in strings:
        c = common_prefix(before, s, 0)
        common.append(c)
        rest.append(s[c:])
        before = s
    return len(strings).to_bytes(4, "little") + _squeeze(bytes(common) + bytes(map(len, rest)) + b"".join(rest))


def front_decoded(blob: bytes) -> tuple[list[bytes], list[int]]:
    """The strings and each one's common prefix with the one before."""
    n, raw = int.from_bytes(blob[:4], "little"), _expand(blob[4:])
    common, out, at, before = list(raw[:n]), [], 2 * n, b""
    for c, k in zip(common, raw[n : 2 * n], strict=True):
        before = before[:c] + raw[at : at + k]
        out.append(before)
        at += k
    return out, common


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[known:m], "big") ^ int.from_bytes(b[known:m], "big")
    return m - (x.bit_length() + 7) // 8


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """Sorted runs with common prefixes as one sorted sequence: string, common prefix with the string before, run, place in it.

    A loser tree.  ``lead[r]`` is the common prefix of run r's head with the last
    winner: of two players the one with the longer one is smaller; if they are equal,
    comparison starts there, and the loser keeps the prefix it shares with the winner.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads, place, lead = [b""] * size, [0] * size, [-1] * size
    for r, (strings, _) in enumerate(runs):
        if strings:
            heads[r], lead[r] = strings[0], 0
    losers = [0] * size

    def play(w: int, other: int) -> tuple[int, int]:
        x, y = lead[w], lead[other]
        if x != y:
            return (w, other) if x > y else (other, w)
        if x < 0:
            return w, other
        a, b = heads[w], heads[other]
        m = min(len(a), len(b))
        d = int.from_bytes(a[x:m], "big") ^ int.from_bytes(b[x:m], "big")
        c = m - (d.bit_length() + 7) // 8
        if c == m and len(a) <= len(b) or c < m and a[c] < b[c]:
            lead[other] = c
            return w, other
        lead[w] = c
        return other, w

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, losers[node] = play(build(2 * node), build(2 * node + 1))
        return w

    w = build(1) if size > 1 else 0
    while lead[w] >= 0:
        i = place[w]
        yield heads[w], lead[w], w, i
        strings, common = runs[w]
        place[w] = i = i + 1
        if i < len(strings):
            heads[w], lead[w] = strings[i], common[i]
        else:
            lead[w] = -1
        node = (w + size) >> 1
        while node:
            other = losers[node]
            x, y = lead[w], lead[other]
            if x > y:
                pass
            elif x < y:
                losers[node], w = w, other
            elif x >= 0:
                w, losers[node] = play(w, other)
            node >>= 1


def merge_all(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """``merged`` in rounds of FAN_IN runs."""
    if len(runs) <= FAN_IN:
        yield from merged(runs)
        return
    groups = []
    for at in range(0, len(runs), FAN_IN):
        got = list(merged(runs[at : at + FAN_IN]))
        groups.append(([g[0] for g in got], [g[1] for g in got], [(g[2] + at, g[3]) for g in got]))
    for s, c, g, i in merge_all([(g[0], g[1]) for g in groups]):
        yield s, c, *groups[g][2][i]


def _suffixes(parts: int, splitters: list[bytes], fingerprint_parts: int):
    """A bucket's candidate suffixes as front-coded runs, and where each came from."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _table([])
        number, own = group.column("bucket")[0].as_py(), Bucket(group)
        got = dict(zip(answers.column("part").to_pylist(), answers.column("a").to_pylist(), strict=True))
        entries: dict[tuple[bytes, bytes], int] = {}  # (right of the anchor, left of it): number
        first: list[int] = []  # smallest document of each
        hot_entries: dict[bytes, int] = {}
        hot_first: list[int] = []
        came: list[tuple[np.ndarray, ...]] = []  # document, anchor's offset in it, entry, hot or not
        prints = self_prints(own, fingerprint_parts, got)
        for (raw, ends, docs, starts), (at, lo, hi, level) in zip(own.chunks(), prints, strict=True):
            pick = np.flatnonzero(level)
            if not len(pick):
                continue
            segment = np.searchsorted(ends, at[pick], "right")
            place, shift = docs[segment], starts[segment] - np.concatenate([[0], ends[:-1]])[segment]
            ids = own.ids[np.array(own.order)[place]].tolist()
            rows_at, rows_entry, rows_hot, rows_place = [], [], [], []
            for p, s, e, kind, doc, d, w in zip(at[pick].tolist(), lo[pick].tolist(), hi[pick].tolist(), level[pick].tolist(), ids, shift.tolist(), place.tolist(), strict=True):
                if kind == 1:
                    i = entries.setdefault((raw[p : e + LENGTH], raw[s:p]), len(first))
                    if i == len(first):  # documents come by id: the first is the smallest
                        first.append(doc)
                    rows_at.append(p + d)
                    rows_entry.append(i)
                    rows_hot.append(0)
                    rows_place.append(w)
                else:
                    for q in range(s, e + 1):
                        i = hot_entries.setdefault(raw[q : q + LENGTH], len(hot_first))
                        if i == len(hot_first):
                            hot_first.append(doc)
                        elif doc < hot_first[i]:
                            hot_first[i] = doc
                        rows_at.append(q + d)
                        rows_entry.append(i)
                        rows_hot.append(1)
                        rows_place.append(w)
            came.append(tuple(np.array(x, np.int64) for x in (rows_place, rows_at, rows_entry, rows_hot)))
        rows = []
        keys = list(entries)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        rank = np.zeros(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        cuts = [bisect.bisect_right(splitters, keys[i][0][:GRAM]) for i in order]
        for r, at in by_part(np.array(cuts, np.int64)):
            mine = [order[i] for i in at.tolist()]
            if mine:
                lefts = [keys[i][1] for i in mine]
                body = _squeeze(bytes(map(len, lefts)) + b"".join(lefts))
                docs = pack_ints(np.array([first[i] for i in mine], np.int64), "<i8")
                rows.append((0, r, number, front_coded([keys[i][0] for i in mine]), len(body).to_bytes(4, "little") + body + docs))
        hot_keys = list(hot_entries)
        hot_part = [int.from_bytes(hashlib.blake2b(k, digest_size=4).digest(), "little") % parts for k in hot_keys]
        hot_order = sorted(range(len(hot_keys)), key=lambda i: (hot_part[i], hot_keys[i]))
        hot_rank = np.zeros(len(hot_keys), np.int64)
        hot_rank[hot_order] = np.arange(len(hot_keys))
        for r, at in by_part(np.array([hot_part[i] for i in hot_order], np.int64)):
            mine = [hot_order[i] for i in at.tolist()]
            if mine:
                rows.append((1, r, number, front_coded([hot_keys[i] for i in mine]), pack_ints(np.array([hot_first[i] for i in mine], np.int64), "<i8")))
        # where each suffix came from, with entries by their rank in the runs
        if came:
            place, at, entry, hot = (np.concatenate(c) for c in zip(*came, strict=True))
            ranked = np.where(hot == 1, 0, 0)
            ranked[hot == 0] = rank[entry[hot == 0]]
            ranked[hot == 1] = hot_rank[entry[hot == 1]]
            blobs = [pack_ints(place, "<u4"), pack_ints(at, "<u4") if len(own.raw) < 1 << 32 else pack_ints(at, "<u8"), pack_ints(ranked, "<u4"), pack_ints(hot, "<u1")]
            blobs += [bytes(len(keys[i][1]) for i in order), bytes(len(keys[i][0]) for i in order), pack_ints(np.array([first[i] for i in order], np.int64), "<i8"), pack_ints(np.array([hot_first[i] for i in hot_order], np.int64), "<i8")]
            rows.append((2, 0, number, b"".join(len(x).to_bytes(8, "little") + x for x in blobs), b""))
        return _table(rows)

    return run


def self_prints(own: Bucket, parts: int, got: dict[int, bytes]) -> list[tuple[np.ndarray, ...]]:
    """Anchors of each chunk with the level that the fingerprint round gave them."""
    found = [anchors(np.frombuffer(raw, np.uint8), ends) for raw, ends, _, _ in own.chunks()]
    grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *[f[3] for f in found]]))
    part, level = (grams % np.uint64(parts)).astype(np.int64), np.zeros(len(grams), np.uint8)
    for r, mine in by_part(part):
        level[mine] = unpack_ints(got[r], "<u1")
    return [(at, lo, hi, level[np.searchsorted(grams, h)]) for at, lo, hi, h in found]


def resolve(group: list[tuple[bytes, bytes, int]]) -> list[tuple[int, int]]:
    """(right, left, document) of suffixes with one anchor gram: how far each one's match with smaller documents reaches left and right of the anchor (0, 0: none)."""
    best: dict[tuple[bytes, bytes], int] = {}
    for right, left, doc in group:
        k = (right, left)
        if best.setdefault(k, doc) > doc:
            best[k] = doc
    low = min(best.values())
    strings: dict[bytes, int] = {}
    for (right, left), doc in best.items():
        both, n = left + right, len(left)
        for o in range(LENGTH - len(right), n + 1):
            s = both[n - o : n - o + LENGTH]
            if strings.setdefault(s, doc) > doc:
                strings[s] = doc
    reach: dict[tuple[bytes, bytes], tuple[int, int]] = {}
    for (right, left), doc in best.items():
        if doc == low:
            reach[right, left] = (0, 0)
            continue
        both, n = left + right, len(left)
        hits = [o for o in range(LENGTH - len(right), n + 1) if strings[both[n - o : n - o + LENGTH]] < doc]
        reach[right, left] = (hits[-1], LENGTH - hits[0]) if hits else (0, 0)
    return [(len(left), len(right)) if best[right, left] < doc else reach[right, left] for right, left, doc in group]


def _ranges():
    """Merge the runs of one range; answer each run."""

    def answer(group: pa.Table) -> pa.Table:
        kind, part, buckets = group.column("kind")[0].as_py(), group.column("part")[0].as_py(), group.column("bucket").to_pylist()
        runs = [front_decoded(x) for x in group.column("a").to_pylist()]
        lefts, docs = [], []
        for (strings, _), blob in zip(runs, group.column("b").to_pylist(), strict=True):
            if kind == 0:
                k = int.from_bytes(blob[:4], "little")
                raw, at, own = _expand(blob[4 : 4 + k]), len(strings), []
                for n in raw[: len(strings)]:
                    own.append(raw[at : at + n])
                    at += n
                lefts.append(own)
                blob = blob[4 + k :]
            docs.append(unpack_ints(blob, "<i8").tolist())
        out = [bytearray(2 * len(s)) for s, _ in runs]

        def settle(members: list[tuple[bytes, int, int]]) -> None:
            if len(members) < 2:
                return
            if kind == 0:
                found = resolve([(s, lefts[r][i], docs[r][i]) for s, r, i in members])
            else:
                low = min(docs[r][i] for _, r, i in members)
                found = [(0, LENGTH) if docs[r][i] > low else (0, 0) for _, r, i in members]
            for (_, r, i), (x, y) in zip(members, found, strict=True):
                out[r][2 * i], out[r][2 * i + 1] = x, y

        alike, members = (GRAM if kind == 0 else LENGTH), []
        for s, c, r, i in merge_all(runs):
            if c < alike:
                settle(members)
                members = []
            members.append((s, r, i))
        settle(members)
        return _table([(kind, part, b, _squeeze(bytes(x)), b"") for b, x in zip(buckets, out, strict=True)])

    return answer


# --- removal


def _removed():
    """A bucket's documents with the bytes that go: per row of the bucket (row, boolean array)."""

    def marks(own: Bucket, answers: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        kinds, part, blobs = (answers.column(c).to_pylist() for c in ("kind", "part", "a"))
        state = next((x for k, x in zip(kinds, blobs, strict=True) if k == 2), None)
        per: dict[int, list[tuple[int, int]]] = {}
        if state is not None:
            cut, at = [], 0
            while at < len(state):
                n = int.from_bytes(state[at : at + 8], "little")
                cut.append(state[at + 8 : at + 8 + n])
                at += 8 + n
            reply = [np.frombuffer(b"".join(_expand(x) for _, x in sorted((p, x) for k, p, x in zip(kinds, part, blobs, strict=True) if k == kind)), np.uint8).reshape(-1, 2).astype(np.int64) for kind in (0, 1)]
            place, offset, entry, hot = unpack_ints(cut[0], "<u4").astype(np.int64), unpack_ints(cut[1], "<u4" if len(own.raw) < 1 << 32 else "<u8").astype(np.int64), unpack_ints(cut[2], "<u4").astype(np.int64), unpack_ints(cut[3], "<u1")
            left, right = np.frombuffer(cut[4], np.uint8).astype(np.int64), np.frombuffer(cut[5], np.uint8).astype(np.int64)
            first, hot_first = unpack_ints(cut[6], "<i8"), unpack_ints(cut[7], "<i8")
            doc = own.ids[np.array(own.order)[place]]
            lo, hi = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            for kind, smallest in ((0, first), (1, hot_first)):
                mine = hot == kind
                if not mine.any():
                    continue
                e = entry[mine]
                later = doc[mine] > smallest[e]  # a smaller document of this bucket has all of it
                whole = (left[e], right[e]) if kind == 0 else (np.zeros(len(e), np.int64), np.full(len(e), LENGTH))
                lo[mine], hi[mine] = np.where(later, whole[0], reply[kind][e, 0]), np.where(later, whole[1], reply[kind][e, 1])
            keep = hi > 0
            start, stop, place = (offset - lo)[keep], (offset + hi)[keep], place[keep]
            order = np.argsort(place, kind="stable")
            start, stop, place = start[order], stop[order], place[order]
            bounds = np.searchsorted(place, np.arange(len(own.order) + 1))
            per = {p: (start[bounds[p] : bounds[p + 1]], stop[bounds[p] : bounds[p + 1]]) for p in np.unique(place).tolist()}
        for p, i in enumerate(own.order):
            n = int(own.offsets[i + 1] - own.offsets[i])
            change = np.zeros(n + 1, np.int32)
            if p in per:
                np.add.at(change, per[p][0], 1)
                np.add.at(change, per[p][1], -1)
            yield i, np.cumsum(change[:-1]) > 0

    return marks


def _digests():
    marks = _removed()

    def digest(group: pa.Table, answers: pa.Table) -> pa.Table:
        own, rows = Bucket(group), []
        for i, gone in marks(own, answers):
            raw = np.frombuffer(own.raw[own.offsets[i] : own.offsets[i + 1]], np.uint8)
            spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            rows.append((int(own.ids[i]), len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table({n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))})

    return digest


def _kept(columns: list[str]):
    """A bucket's rows as they came, their texts cut."""
    marks = _removed()

    def keep(group: pa.Table, answers: pa.Table) -> pa.Table:
        own, rest, at, kept = Bucket(group), unpack_structs(group.column("rest").to_pylist()), [], []
        for i, gone in marks(own, answers):
            raw = np.frombuffer(own.raw[own.offsets[i] : own.offsets[i + 1]], np.uint8)
            if gone.any():  # a character is kept whole or not at all
                lead = np.cumsum((raw & 0xC0) != 0x80) - 1
                touched = np.zeros(lead[-1] + 1, bool)
                touched[lead[gone]] = True
                gone = touched[lead]
            at.append(i)
            kept.append(raw[~gone].tobytes().decode())
        rest = rest.take(pa.array(at, pa.int64()))
        absent = rest.field(len(columns)).to_pylist()
        text = pa.array([None if none else x for none, x in zip(absent, kept, strict=True)], pa.string())
        return pa.table([text if c == "text" else rest.field(k) for k, c in enumerate(columns)], columns)

    return keep


def _bucketed(own: DataFrame, hot: int, each: int) -> tuple[DataFrame, int]:
    """For each bucket what its suffixes were answered, and the number of buckets; own: doc_id, text."""
    n = bucket_count(text_bytes(own), each)
    parts = max(4, n // 2)
    rows = packed_documents(bucketed(own, n), each=each)
    prints = checkpoint(rows.groupBy("bucket").applyInArrow(_prints(parts, n), _RUN_SCHEMA), release=True)
    sample = sorted(x[i : i + GRAM] for (x,) in prints.filter("kind = 1").select("a").collect() for x in [bytes(x)] for i in range(0, len(x), GRAM))  # a few for each range
    splitters = sorted(set(sample[len(sample) * k // parts] for k in range(1, parts))) if sample else []
    repeated = prints.filter("kind = 0").groupBy("part").applyInArrow(_repeated(hot), _RUN_SCHEMA)
    runs = checkpoint(rows.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(_suffixes(parts, splitters, parts), _RUN_SCHEMA), release=True)
    answers = runs.filter("kind < 2").groupBy("kind", "part").applyInArrow(_ranges(), _RUN_SCHEMA)
    return runs.filter("kind = 2").unionByName(answers), n


def removal(docs: DataFrame, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of each document."""
    own = numbered(docs)
    answers, n = _bucketed(own, hot, bucket_bytes)
    rows = packed_documents(bucketed(own, n), each=bucket_bytes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return unnumbered(rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_digests(), schema), "doc_id")


def deduplicated(docs: DataFrame, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents with repeated passages cut from ``text``; a character loses all its bytes or none.

    Rows travel whole, so that a null or repeated doc_id makes no difference; a null
    text stays null.
    """
    own = numbered(docs)
    answers, n = _bucketed(own, hot, bucket_bytes)
    columns = docs.columns
    rest = F.struct(*[F.lit(None).cast("string").alias(c) if c == "text" else docs[c].alias(c) for c in columns], docs["text"].isNull().alias("_absent")).alias("rest")
    whole = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), rest)
    rows = packed_documents(bucketed(whole, n), "rest", bucket_bytes)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields])
    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_kept(columns), schema)
