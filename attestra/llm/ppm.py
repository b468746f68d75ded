"""Language-model scoring by prediction by partial matching (PPM).

The model is a byte-context trie of order ``order`` over the token stream of the
training documents (words joined by one space, then an end), with PPM-C escapes and
full symbol exclusion.  Since a symbol's probability depends on its last ``order``
bytes alone, the trie never has to be in one place:

1. Each bucket of documents sends its distinct (context, symbol) keys with training
   counts, as front-coded sorted runs, to the trie part of the context's last two
   bytes.  A key puts the most recent byte first, so a trie node of any order is a
   contiguous range and all orders above one are within a part.
2. Each part merges its runs, builds the counts of every order, and answers each run
   with the log-probabilities of its keys, in the run's order.  Contexts of one byte
   (at most 65,536 counts) are summed beforehand and given to every part.
3. Buckets meet the answers and add up code lengths per document.

Tokens' counts for the base score travel in the same way.  What is gathered grows
with the corpus, and nothing but the two-byte table and two totals reaches the driver.

Defined results: a null or empty text, or one of blanks, is the end token alone; with
no training document every symbol has probability 1/256; null and repeated doc_ids are
scored row by row, and a null one is for training only if the flag says so; columns besides doc_id, text and the training flag are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import BUCKET_BYTES, NO_ID, bucket_count, bucketed, by_part, checkpoint, mix64, pack_ints, pack_sorted, packed_documents, text_bytes, unpack_ints, unpack_sorted, unpack_structs, unpack_texts

ORDER = 5
#: Bytes that no UTF-8 text holds: before a text's first symbol, and its end.
START, END = 0xFE, 0xFF
CHUNK = 1 << 20


class Documents:
    """A bucket's documents, lower-cased, in an order that does not depend on how rows arrive."""

    def __init__(self, group: pa.Table):
        order, offsets, self.raw = unpack_texts(group.column("packed").to_pylist())
        rest = unpack_structs(group.column("rest").to_pylist())
        self.ids, self.train = rest.field("doc_id"), rest.field("train").to_numpy(zero_copy_only=False).astype(bool)
        self.offsets, self.order = offsets.tolist(), np.argsort(order, kind="stable").tolist()

    def __iter__(self) -> Iterator[tuple[int, bytes, bool]]:
        """Row number, text and training flag."""
        for i in self.order:
            yield i, self.raw[self.offsets[i] : self.offsets[i + 1]].lower(), bool(self.train[i])

    def __len__(self) -> int:
        return len(self.order)


def streams(docs: Documents, order: int) -> Iterator[tuple[np.ndarray, list[int], list[int], np.ndarray]]:
    """Chunks of documents: keys of all symbols, rows, symbols of each, and which keys are for training."""
    parts, rows, sizes, flags, held = [], [], [], [], 0

    def chunk():
        a = np.frombuffer(b"".join(parts), np.uint8)
        n = len(a) - order
        keys = np.zeros(n, np.uint64)
        for j in range(1, order + 1):
            keys = keys << np.uint64(8) | a[order - j : order - j + n]
        keys = keys << np.uint64(8) | a[order:]
        return keys[a[order:] != START], rows, sizes, np.repeat(np.array(flags, bool), sizes)

    pad, end = bytes([START]) * order, bytes([END])
    for i, text, train in docs:
        body = b" ".join(text.split())
        parts += [pad, body, end]
        rows.append(i)
        sizes.append(len(body) + 1)
        flags.append(train)
        held += len(body)
        if held > CHUNK:
            yield chunk()
            parts, rows, sizes, flags, held = [], [], [], [], 0
    if rows:
        yield chunk()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def key_counts(docs: Documents, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket's distinct keys with training counts (0: only in documents that are not for training)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    one = np.uint64(1)
    for found, _, _, train in streams(docs, order):
        flagged = found << one | train  # a key and its flag fit 64 bits: one plain sort
        flagged.sort()
        first = np.flatnonzero(np.concatenate([[True], flagged[1:] != flagged[:-1]]))
        own, n = flagged[first], np.diff(np.append(first, len(flagged)))
        held.append((own >> one, np.where((own & one).astype(bool), n, 0)))
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))


def part_of(keys: np.ndarray, order: int, parts: int) -> np.ndarray:
    return (mix64(keys >> np.uint64(8 * (order - 1))) % np.uint64(parts)).astype(np.int64)


def token_counts(docs: Documents) -> tuple[list[bytes], np.ndarray, int]:
    """The bucket's distinct words in order, their training counts, and training tokens with ends."""
    known: Counter = Counter()
    every: set[bytes] = set()
    total = 0
    for _, text, train in docs:
        words = text.split()
        every.update(words)
        if train:
            known.update(words)
            total += len(words) + 1
    tokens = sorted(every)
    return tokens, np.array([known[t] for t in tokens], np.int64), total


def token_parts(tokens: list[bytes], parts: int) -> np.ndarray:
    import xxhash

    return (np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)) % np.uint64(parts)).astype(np.int64)


class Trie:
    """The part of the trie whose contexts end in this part's byte pairs, with the counts of every order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int):
        self.order = order
        seen = counts > 0
        keys, counts = keys[seen], counts[seen]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = [None] * (order + 1)  # type: ignore[list-item]
        self.nodes: list[tuple[np.ndarray, ...]] = [None] * (order + 1)  # type: ignore[list-item]
        eight, symbol = np.uint64(8), np.uint64(0xFF)
        for j in range(order + 1):
            if j >= 2:
                self.edges[j] = summed((keys >> np.uint64(8 * (order + 1 - j))) << eight | (keys & symbol), counts)
            elif j == 1:
                self.edges[j] = low
            else:
                self.edges[j] = summed(low[0] & symbol, low[1])
        for j, (edge, n) in enumerate(self.edges):
            context = edge >> eight
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(edge) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(edge) else n
            distinct = np.diff(np.append(first, len(edge)))
            excluded = np.zeros(len(first), np.int64)
            if j and len(edge):  # what the shorter context has of this context's symbols
                shorter = (context >> eight) << eight | (edge & symbol)  # without the oldest byte, which is the lowest
                lower, m = self.edges[j - 1]
                excluded = np.add.reduceat(m[np.searchsorted(lower, shorter)], first)
            self.nodes[j] = (context[first], total, distinct, excluded)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log10 probability of each key's symbol in its context."""
        out, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
        gone_q, gone_t = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        eight, symbol = np.uint64(8), np.uint64(0xFF)
        for j in range(self.order, -1, -1):
            context, total, distinct, excluded = self.nodes[j]
            edge, n = self.edges[j]
            if not len(edge):
                continue
            own = keys >> np.uint64(8 * (self.order + 1 - j)) if j else np.zeros(len(keys), np.uint64)
            at = np.minimum(np.searchsorted(context, own), len(context) - 1)
            live = ~done & (context[at] == own)
            t, q = total[at] - gone_t, distinct[at] - gone_q
            wanted = own << eight | (keys & symbol)
            e = np.minimum(np.searchsorted(edge, wanted), len(edge) - 1)
            hit = live & (edge[e] == wanted)
            out[hit] += np.log10(n[e[hit]] / (t[hit] + q[hit]))
            miss = live & ~hit & (q > 0)
            out[miss] += np.log10(q[miss] / (t[miss] + q[miss]))
            done |= hit
            gone_t, gone_q = np.where(live, excluded[at], gone_t), np.where(live, distinct[at], gone_q)
        out[~done] -= np.log10(np.maximum(256 - gone_q[~done], 1))
        return out


def _runs(order: int, parts: int):
    """Step 1: rows of (kind, part, bucket, keys, counts) for a bucket."""

    def run(group: pa.Table) -> pa.Table:
        bucket, rows, docs = group.column("bucket")[0].as_py(), [], Documents(group)
        keys, counts = key_counts(docs, order)
        part = part_of(keys, order, parts)
        for r, own in by_part(part):
            rows.append((0, r, bucket, pack_sorted(keys[own]), pack_ints(counts[own], "<u4"), 0))
        pair = (keys >> np.uint64(8 * order)) << np.uint64(8) | (keys & np.uint64(0xFF))
        low, n = summed(pair, counts)
        rows.append((2, 0, bucket, pack_ints(low[n > 0], "<u2"), pack_ints(n[n > 0], "<u8"), 0))
        tokens, n, total = token_counts(docs)
        part = token_parts(tokens, parts)
        for r, own in by_part(part):
            rows.append((1, r, bucket, _squeeze(b"\n".join([tokens[i] for i in own.tolist()])), pack_ints(n[own], "<u4"), 0))
        rows.append((3, 0, bucket, b"", b"", total))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
        return pa.table({name: pa.array([x[i] for x in rows], kinds[i]) for i, name in enumerate(("kind", "part", "bucket", "keys", "counts", "total"))})

    return run


def _squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(raw)


def _expand(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def _answers(order: int, low: tuple[np.ndarray, np.ndarray]):
    """Step 2: one part of the trie or of the words answers its runs, with the number of known words."""

    def answer(group: pa.Table) -> pa.Table:
        kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
        buckets, blobs, numbers = (group.column(c).to_pylist() for c in ("bucket", "keys", "counts"))
        known, out = 0, []
        if kind == 0:
            runs = [unpack_sorted(x) for x in blobs]
            keys, counts = summed(np.concatenate(runs), np.concatenate([unpack_ints(x, "<u4") for x in numbers]).astype(np.int64))
            logs = Trie(keys, counts, low, order).log10(keys).astype("<f4")
            out = [logs[np.searchsorted(keys, x)].tobytes() for x in runs]
        else:
            runs = [_expand(x).split(b"\n") for x in blobs]
            total: dict[bytes, int] = {}
            for run, n in zip(runs, numbers, strict=True):
                for t, c in zip(run, unpack_ints(n, "<u4").tolist(), strict=True):
                    total[t] = total.get(t, 0) + c
            known = sum(c > 0 for c in total.values())
            out = [pack_ints(np.array([total[t] for t in x], np.int64), "<u8") for x in runs]
        n = len(buckets)
        return pa.table({"kind": pa.array([kind] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "answer": pa.array(out, pa.binary()), "known": pa.array([known, *[0] * (n - 1)], pa.int64())})

    return answer


def _scores(order: int, parts: int, n_train: int, n_known: int, ends: int):
    """Step 3: a bucket's documents meet the answers."""

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _SCORED.items()})
        got = {(k, p): a for k, p, a in zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(), answers.column("answer").to_pylist(), strict=True)}
        docs = Documents(group)
        keys, _ = key_counts(docs, order)
        part, logs = part_of(keys, order, parts), np.zeros(len(keys), np.float32)
        for r, own in by_part(part):
            logs[own] = np.frombuffer(got[0, r], "<f4")
        model = np.zeros(len(docs))
        for found, rows, sizes, _train in streams(docs, order):
            at = np.argsort(found)  # look-ups in order stay in the cache
            each = np.zeros(len(found))
            each[at] = logs[np.searchsorted(keys, found[at])]
            model[rows] = np.add.reduceat(each, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        tokens, _, _ = token_counts(docs)
        part, counts = token_parts(tokens, parts), np.zeros(len(tokens), np.int64)
        for r, own in by_part(part):
            counts[own] = unpack_ints(got[1, r], "<u8").astype(np.int64)
        whole = n_train + 0.5 * (n_known + 1)
        logged = np.log10((np.append(counts, ends) + 0.5) / whole)
        place = {t: i for i, t in enumerate(tokens)}
        base, n_tokens, known = np.zeros(len(docs)), np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        some = np.append(counts, ends) > 0
        for i, text, _train in docs:
            c = np.array([*map(place.__getitem__, text.split()), len(tokens)])
            base[i], n_tokens[i], known[i] = logged[c].sum(), len(c), some[c].sum()
        columns = (docs.ids, ~docs.train, n_tokens, known, np.full(len(docs), n_train), base, model)
        return pa.table({n: pa.array(c, t) if isinstance(c, np.ndarray) else c for (n, t), c in zip(_SCORED.items(), columns, strict=True)})

    return score


_SCORED = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def score(docs: DataFrame, training: Column, order: int = ORDER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words' counts), score (the PPM model).

    training: which documents the model and the counts learn from.
    """
    if not 1 <= order <= 6:
        raise ValueError(f"order must be 1 to 6: {order}")
    flags = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("train"))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), flags.alias("flags"))
    n = bucket_count(text_bytes(own), bucket_bytes)
    parts = max(4, n // 2)
    rows = packed_documents(bucketed(own, n), "flags", bucket_bytes)
    runs = checkpoint(rows.groupBy("bucket").applyInArrow(_runs(order, parts), "kind int, part int, bucket int, keys binary, counts binary, total long"), release=True)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, counts = summed(np.concatenate([keys, unpack_ints(k, "<u2").astype(np.uint64)]), np.concatenate([counts, unpack_ints(c, "<u8").astype(np.int64)]))
        yield pa.record_batch({"pair": pa.array(keys.astype(np.int64)), "n": pa.array(counts)})

    table = runs.filter("kind = 2").select("keys", "counts").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n")).collect()  # at most 65,536 rows
    table.sort()
    low = (np.array([x[0] for x in table], np.uint64), np.array([x[1] for x in table], np.int64))
    n_train = runs.filter("kind = 3").agg(F.sum("total")).first()[0] or 0
    answers = checkpoint(runs.filter("kind < 2").groupBy("kind", "part").applyInArrow(_answers(order, low), "kind int, part int, bucket int, answer binary, known long"), release=True)
    ends = int(low[1][(low[0] & np.uint64(0xFF)) == END].sum()) if len(table) else 0
    known = (answers.agg(F.sum("known")).first()[0] or 0) + (ends > 0)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("bucket").cogroup(answers.select("bucket", "kind", "part", "answer").groupBy("bucket")).applyInArrow(_scores(order, parts, n_train, known, ends), schema)
