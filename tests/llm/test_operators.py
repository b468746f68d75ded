"""Each operator against brute force on documents with awkward cases."""

import collections
import datetime
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestra.llm import byte_bpe, components, compression_classifier, fuzzy_passages, packing, pii, ppm, quality_rules, simhash, substring_dedup, top_k
from attestra.llm.common import NO_ID, numbered
from attestra.llm.queries import OP10_SQL, fold
from tests.llm.conftest import WORDS

P = pytest.importorskip("public_tokenizers")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words_of(text):
    return (text or "").encode().lower().split()


# --- 1


def test_ppm_base_counts_and_probabilities(docs, rows, empty):
    got = by_id(ppm.score(docs, fold(5) != 1, order=3))
    train = [words_of(t) for d, t, *_ in rows if zlib.crc32(str(d).encode()) % 5 != 1]
    c = collections.Counter(w for x in train for w in x)
    c[None] = len(train)
    total, distinct = sum(c.values()), len(c)
    for d, t, *_ in rows:
        own = [*words_of(t), None]
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(base) and r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 1)
        assert r["score"] == pytest.approx(brute_ppm([b" ".join(x) for x in train], b" ".join(words_of(t)), 3), rel=1e-4)
    assert ppm.score(empty, F.lit(True)).count() == 0
    assert ppm.score(docs, F.lit(False), order=2).agg(F.max("train_tokens")).first()[0] == 0


def brute_ppm(train, text, order):
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    seq = lambda x: [ppm.START] * order + list(x) + [ppm.END]
    for t in train:
        s = seq(t)
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[j][tuple(s[i - j : i])][s[i]] += 1
    s, out = seq(text), 0.0
    for i in range(order, len(s)):
        gone = set()
        for j in range(order, -1, -1):
            node = counts[j].get(tuple(s[i - j : i]))
            if not node:
                continue
            left = {k: v for k, v in node.items() if k not in gone}
            if s[i] in left:
                out += math.log10(left[s[i]] / (sum(left.values()) + len(left)))
                break
            if left:
                out += math.log10(len(left) / (sum(left.values()) + len(left)))
            gone |= set(node)
        else:
            out -= math.log10(256 - len(gone))
    return out


def test_ppm_sums_to_one():
    keys = np.array(sorted({(a << 16) | (b << 8) | s for a, b, s in [(97, 98, 99), (97, 98, 100), (98, 97, 99), (97, 255, 97)]}), np.uint64)
    low_keys, low_counts = ppm.summed((keys >> np.uint64(16)) << np.uint64(8) | (keys & np.uint64(255)), np.array([3, 1, 2, 5]))
    trie = ppm.Trie(keys, np.array([3, 1, 2, 5]), (low_keys, low_counts), 2)
    for context in (97 << 8 | 98, 98 << 8 | 97, 97 << 8 | 1, 1 << 8 | 1):
        every = np.array([context << 8 | s for s in range(256)], np.uint64)
        assert (10 ** trie.log10(every)).sum() == pytest.approx(1)


# --- 2


def test_packing(docs, rows, empty):
    path = P.path("word_bpe_49k.json")
    got = packing.pack(packing.pieces(docs, path)).collect()
    check_packing(got, {d: t or "" for d, t, *_ in rows}, path)
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def check_packing(got, texts, path, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    want = {}
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[d, k] = (at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(v[1] for v in want.values()) // capacity)


def test_word_ids_equal_the_library():
    bpe = packing.WordBPE(P.path("word_bpe_49k.json"))
    odd = ["İstanbul. ΑΣ Σ", "éa b", "it's we'LL 'tis", "<|endoftext|> x<|endoftext|>", "ﬁ ǅ ẞ K İ.", "a'b''s 12ab34", "x\x1cy z", "日本 語、テスト 🧾", "a.,b ,. c,,d _. ._", "don’t “x” #$% a.b,c", ""]
    assert bpe.encode_batch(odd) == [bpe.whole([t])[0] for t in odd]


def test_bin_slack_is_near_the_bound():
    rng = random.Random(5)
    h = collections.Counter(min(100, 1 + int(rng.expovariate(1 / 30))) for _ in range(3000))
    plan = packing.minimum_bin_slack(dict(h), 100)
    used = collections.Counter()
    for times, lengths in plan:
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += times
    assert used == h and sum(t for t, _ in plan) <= -(-sum(k * v for k, v in h.items()) // 100) + 2
    assert packing.fullest({7: 1, 5: 2, 3: 1}, 13) in ([7, 5], [5, 5, 3]) or sum(packing.fullest({7: 1, 5: 2, 3: 1}, 13)) == 13


# --- 3


def brute_removal(pairs, length=50):
    first, out = {}, {}
    for d, t in sorted(pairs, key=lambda x: x[0]):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], d)
    for d, t in pairs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < d:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 2])
def test_substring_removal(docs, rows, hot):
    want = brute_removal([(d, t) for d, t, *_ in rows])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.removal(docs, hot).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 5000


def test_substring_edges(empty, docs):
    assert substring_dedup.removal(empty).count() == 0
    out = substring_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_loser_tree_and_front_coding():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(0, 30))) for _ in range(7)]
    coded = [substring_dedup.front_decoded(substring_dedup.front_coded(r)) for r in runs]
    assert [c[0] for c in coded] == runs
    got = list(substring_dedup.merged(coded))
    assert [g[0] for g in got] == sorted(x for r in runs for x in r)
    before = b""
    for s, c, r, i in got:
        assert c == substring_dedup.common_prefix(before, s, 0) and runs[r][i] == s
        before = s


# --- 4


def brute_rules(text):
    text = text or ""
    w = [x for x in text.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if x]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def test_quality_rules(docs, rows, empty):
    got = by_id(quality_rules.judge(docs))
    for d, t, *_ in rows:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_rules(t), d
        assert not (r["base_failed"] and r["kept"])
    assert got[21]["kept"] and quality_rules.judge(empty).count() == 0
    assert quality_rules.keep(docs).columns == docs.columns


def test_estimate_finds_the_bad_class():
    clean, junk = (1, 1, 1, 0, 0, 0), (1, 1, 1, -1, 0, 0)
    post = quality_rules.estimate([(clean, 900), (junk, 60), ((1, 1, -1, 0, -1, -1), 40)]).posterior
    assert post[clean] > 0.9 > 0.5 > post[junk] and quality_rules.estimate([]).posterior == {}


def test_estimate_recovers_planted_accuracies():
    rng = np.random.default_rng(5)
    n, share = 60000, 0.7
    good = rng.random(n) < share
    two = [((0.5, 0.2, 0.3), (0.1, 0.1, 0.8)), ((0.3, 0.3, 0.4), (0.05, 0.15, 0.8)), ((0.6, 0.1, 0.3), (0.02, 0.08, 0.9))]
    one = [((0.5, 0.5), (0.0001, 0.9999)), ((0.3, 0.7), (0.0001, 0.9999)), ((0.4, 0.6), (0.0001, 0.9999))]
    columns = [np.where(good, rng.choice([-1, 0, 1], n, p=g), rng.choice([-1, 0, 1], n, p=b)) for b, g in two] + [np.where(good, rng.choice([-1, 0], n, p=g), rng.choice([-1, 0], n, p=b)) for b, g in one]
    patterns = sorted(collections.Counter(map(tuple, np.stack(columns, axis=1).tolist())).items())
    e = quality_rules.estimate(patterns, rounds=300)
    assert abs(e.balance - share) < 0.02
    for j, (b, g) in enumerate(two):
        for side, want in ((0, b), (1, g)):
            assert all(abs(e.rates[side][j][v] - w) < 0.03 for v, w in zip((-1, 0, 1), want, strict=True)), (j, side)
    for j, (b, g) in enumerate(one, 3):
        assert abs(e.rates[0][j][-1] - b[0]) < 0.03 and e.rates[1][j][-1] <= 0.0002
    wrong = sum(c * (1 - e.posterior[p] if e.posterior[p] >= 0.5 else e.posterior[p]) for p, c in patterns) / n
    assert wrong < 0.1


def test_verdicts_equal_an_estimate_row_by_row(docs):
    """The same model without the table of patterns, over a matrix of votes."""
    rules = quality_rules.votes()
    rows = quality_rules.measures(docs).select("doc_id", "base_failed", *[c.alias(k) for k, c in rules.items()]).collect()
    v = np.array([[r[k] for k in rules] for r in rows])
    rate = np.array([[[b[s][x] for x in (-1, 0, 1)] for b in quality_rules.BELIEFS] for s in (0, 1)])
    first, share = rate.copy(), 0.8
    for _ in range(100):
        odds = np.array([(1 - share) * np.prod([rate[0, j, v[:, j] + 1] for j in range(6)], axis=0), share * np.prod([rate[1, j, v[:, j] + 1] for j in range(6)], axis=0)])
        post = odds[1] / odds.sum(axis=0)
        share = (post.sum() + 50 * 0.8) / (len(v) + 50)
        for s, w in ((0, 1 - post), (1, post)):
            for j in range(6):
                rate[s, j] = (np.array([w[v[:, j] == x].sum() for x in (-1, 0, 1)]) + 50 * first[s, j]) / (w.sum() + 50)
        for j in (3, 4, 5):
            if rate[1, j, 0] > 0.0002:
                rate[1, j, :2] = 0.0002, 0.9998
    want = {r["doc_id"]: (not r["base_failed"] and x >= 0.5, round(float(x), 9)) for r, x in zip(rows, post, strict=True)}
    assert {r["doc_id"]: (r["kept"], round(r["quality_probability"], 9)) for r in quality_rules.judge(docs).collect()} == want


# --- 5


def test_byte_bpe_equals_tiktoken(docs, rows, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.codec(path, P.PATTERN)
    tokenizer = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(zip(bpe.vocabulary, bpe.ranks, strict=True)), special_tokens={})
    got = by_id(byte_bpe.round_trip(docs, path, P.PATTERN))
    for d, t, *_ in rows:
        ids = tokenizer.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == want
    assert byte_bpe.round_trip(empty, path, P.PATTERN).count() == 0
    back = by_id(byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN))
    assert all(bytes(back[d]["decoded"]) == (t or "").encode() for d, t, *_ in rows)
    for t in ("  a  b", "a\n\nb c", "x \n y", "don't  ", "\n", " lead", "a\x1cb c", "a  b"):
        assert np.frombuffer(bpe.encode_batch([t])[0], "<u4").tolist() == tokenizer.encode_ordinary(t)


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = byte_bpe.PerfectHash(keys)
    assert h.find(keys) == list(range(3000)) and h.find([b"other", b""]) == [-1, -1] and sorted(h.slots(h.hashes(keys)).tolist()) == list(range(3000))


# --- 6


def brute_print(text):
    w = words_of(text)
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_simhash(docs, rows, empty):
    got = by_id(simhash.near_duplicates(docs))
    prints = {d: brute_print(t) for d, t, *_ in rows}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{prints[d]:016x}", find(d)) for d in prints}
    assert simhash.near_duplicates(empty).count() == 0


def test_masks_cover_every_pair():
    rng, all_masks = random.Random(1), simhash.masks(4)
    assert len(all_masks) == 31
    for _ in range(20000):
        d = sum(1 << i for i in rng.sample(range(64), 4))
        assert any(m & d == 0 for m in all_masks)


def test_large_buckets_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 8)
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    a, b = simhash.bucket_links(fps, ((1 << 64) - 1) ^ ((1 << 12) - 1), 1)
    near = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 1]
    x, y = components.forest(np.array([p[0] for p in near]), np.array([p[1] for p in near]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == dict(zip(x.tolist(), y.tolist(), strict=True))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (500, 500)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long").repartition(8)).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 200, 300)}


def test_representatives(docs, rows):
    left = {r["doc_id"]: r["text"] for r in simhash.representatives(docs).collect()}
    first = {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t or "", d)
    assert set(left) <= set(first.values()) and first[rows[2][1]] in left and len(left) == len(set(left.values()))
    assert sum(rows[3][1].split()[5:60] == (t or "").split()[5:60] for t in left.values()) == 1


def test_representatives_find_added_and_cut_text(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    new = lambda n: [words[min(3999, int(rng.paretovariate(0.6)))] for _ in range(n)]
    texts = []
    for k in range(40):
        own = new(60 + 12 * k)
        texts += [own, own + new(len(own) * (10 + k % 12) // 100), own[: len(own) * (99 - k % 16) // 100], own[len(own) // 10 :]]
    rng.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if alike(x, sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    want = sorted(set(group))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.representatives(df).collect()) == want and len(want) < 80


# --- 7


def test_pseudonyms(spark, docs, empty):
    text = "call +1 (017) 555-7713 or cin.97@mail9.example.com, card 4539 5787 6362 1486, no card 9807915762804490, born 1984-02-29 or 31/12/1999, not 2023-13-40; ip 97.51.17.173. ssn 078-05-1120, no ssn 666-05-1120 key b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    df = spark.createDataFrame([(1, text), (2, text.upper()), (3, None), (4, ""), (5, "no 12 data v1.2.3.4.5"), (6, "4539578763621486"), (None, text)], "doc_id long, text string")
    rows = pii.pseudonymise(df, "key", count="n").collect()
    got = {r["doc_id"]: (r["text"], r["n"]) for r in rows}
    out = got[1][0]
    assert got[1][1] == 8 and got[3] == (None, 0) and got[4] == ("", 0) and got[5] == (df.collect()[4]["text"], 0) and got[None] == got[1] and len(rows) == 7
    for kept in ("2023-13-40", "9807915762804490", "666-05-1120"):
        assert kept in out
    for secret in ("555-7713", "cin.97@", "4539 5787", "1984-02-29", "31/12/1999", "97.51.17.173", "078-05-1120", "b44e15e0"):
        assert secret not in out
    assert got[2][0] == out.upper()
    card = out.split("card ")[1][:19].replace(" ", "")
    assert got[6][0] == card and luhn_ok(card)
    assert pii.pseudonymise(docs, "key").columns == docs.columns and pii.pseudonymise(empty, "key").count() == 0
    assert by_id(pii.pseudonymise(df, "other"))[6]["text"] != card


def test_pseudonyms_equal_a_plain_feistel_network(spark):
    def digest(key, tweak, i, n, side, digits=15):
        return hashlib.sha256(f"{key}|{tweak}|{i}|{n}|{side}".encode()).hexdigest()[:digits]

    def written(x, radix, n):
        out = ""
        for _ in range(n):
            x, d = divmod(x, radix)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        return out

    def network(s, radix, tweak):
        n = len(s)
        if n == 1:
            return written((int(s, radix) + int(digest("k", tweak, 0, 1, ""), 16) % radix) % radix, radix, 1)
        a, b = s[: n // 2], s[n // 2 :]
        for i in range(10):
            m = radix ** len(a)
            a, b = b, written((int(a, radix) + int(digest("k", tweak, i, n, b), 16) % m) % m, radix, len(a))
        return a + b

    def pair(a, b, p, q, tweak):
        for i in range(10):
            a = (a + int(digest("k", tweak, i, 0, b), 16)) % p
            b = (b + int(digest("k", tweak, i, 1, a), 16)) % q
        return a, b

    def woven(template, values, keep=str.isalnum):
        values = iter(values)
        return "".join(next(values) if keep(c) else c for c in template)

    def check_digit(head):
        return next(d for d in "0123456789" if luhn_ok(head + d))

    def secret(s):
        a, b = s[: len(s) // 2], s[len(s) // 2 :]
        for i in range(10):
            f = digest("k", "secret", i, len(s), b, 64)
            a, b = b, "".join(f"{int(x, 16) ^ int(y, 16):x}" for x, y in zip(a, f, strict=False))
        return a + b

    rng, cases = random.Random(2), {}
    for _ in range(40):
        head = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 18)))
        new = network(head, 10, "card")
        cases[head + check_digit(head)] = new + check_digit(new)
        local = "".join(rng.choice("abcxyz019._") for _ in range(rng.randint(1, 40))).strip("._") or "a"
        small = [c for c in local if c.isalnum()]
        changed = "".join(network("".join(small[i : i + 22]), 36, "mail") for i in range(0, len(small), 22))
        cases[local + "@a-b.example.org"] = woven(local, changed) + "@a-b.example.org"
        area, group, serial = rng.choice([1, 665, 667, 899, rng.randint(1, 600)]), rng.randint(1, 99), rng.randint(1, 9999)
        a, b = pair((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        x = a // 99 + 1
        cases[f"{area:03}-{group:02}-{serial:04}"] = f"{x + (x >= 666):03}-{a % 99 + 1:02}-{b + 1:04}"
        day = rng.randrange(73049)
        a, b = pair(day // 17, day % 17, 4297, 17, "date")
        iso = lambda n: (datetime.date(1900, 1, 1) + datetime.timedelta(n)).isoformat()
        cases[iso(day)] = iso(a * 17 + b)
        octets = [rng.randrange(256) for _ in range(4)]
        h = network("".join(f"{o:02x}" for o in octets), 16, "ip")
        cases[".".join(map(str, octets))] = ".".join(str(int(h[i : i + 2], 16)) for i in range(0, 8, 2))
        rest = "".join(rng.choice("0123456789") for _ in range(10))
        new = network(rest, 10, "phone")
        cases[f"+44 ({rest[:3]}) {rest[3:6]}-{rest[6:]}"] = f"+44 ({new[:3]}) {new[3:6]}-{new[6:]}"
        hexa = "a" + "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(31, 63)))
        cases[hexa] = secret(hexa)
    df = spark.createDataFrame([(v, f"see {v} there") for v in cases], "value string, text string")
    assert {r["value"]: r["text"] for r in pii.pseudonymise(df, "k").collect()} == {v: f"see {x} there" for v, x in cases.items()}


def test_pseudonyms_of_long_and_hostile_texts(spark):
    n = 1 << 20
    texts = ["x" * n + " 1", "7" * n, "x@" + "a." * 5000, "x@" + "a" * n, "@" * n, "1 " * (n // 2), "+" * n, "1." * (n // 2), "a@b.co " * 20000, "0123456789abcdef" * (n // 16), "a" * n + "@b.co", "a.-" * (n // 3)]
    began = time.time()
    out = [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string").repartition(len(texts)), "k").collect()]
    assert sorted(map(len, out)) == sorted(map(len, texts)) and time.time() - began < 60


def luhn_ok(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_permutations_are_one_to_one(spark):
    ids = spark.range(1000)
    assert ids.select(pii.permuted(F.lpad(F.col("id").cast("string"), 3, "0"), 10, "k", "t").alias("x")).distinct().count() == 1000
    assert ids.select(pii._date(F.col("id").cast("int"), "k").alias("x")).filter("x >= 0 and x < 73049").distinct().count() == 1000
    assert ids.limit(256).select(pii.xored(F.lower(F.lpad(F.hex("id"), 2, "0")), "k", "t").alias("x")).distinct().count() == 256


# --- 8


def test_fuzzy_passages(docs, rows, empty):
    found = fuzzy_passages.passages(docs).collect()
    texts = {d: words_of(t) for d, t, *_ in rows}
    for r in found:
        assert r["source_id"] < r["doc_id"]
        a = texts[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]]
        b = texts[r["source_id"]][r["source_start"] : r["source_start"] + r["source_words"]]
        assert r["matched_words"] == brute_lcs(a, b) and r["similarity"] == pytest.approx(r["matched_words"] / max(len(a), len(b))) and r["similarity"] >= 0.8
    got = {(r["doc_id"], r["source_id"]) for r in found}
    edited, copied, base = rows[13][0], rows[11][0], rows[3][0]
    assert (edited, base) in got and (copied, base) in got and (rows[15][0], rows[14][0]) in got and (rows[16][0], rows[14][0]) in got
    assert not {rows[i][0] for i in (0, 1, 5, 6, 8, 9, 10)} & {d for d, _ in got} and fuzzy_passages.passages(empty).count() == 0


@pytest.mark.parametrize("between", [(80, 80), (0, 80), (80, 0), (400, 30)])
def test_fuzzy_passages_do_not_swallow_each_other(spark, between):
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    first, second = new(60), new(60)
    texts = [[*new(20), *first, *new(n), *second, *new(20)] for n in between]
    found = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts, 1)], "doc_id long, text string")).collect()
    assert len(found) == 2
    for r, at in zip(sorted(found, key=lambda r: r["start_word"]), (20, 80 + between[1]), strict=True):
        assert (r["doc_id"], r["source_id"], r["similarity"]) == (2, 1, 1.0)
        assert at <= r["start_word"] <= at + 3 and at + 57 <= r["start_word"] + r["n_words"] <= at + 60


def test_fuzzy_passages_beside_holders_of_parts(spark):
    """A copy of a later document is found though earlier ones hold its parts, or an older wording."""
    rng = random.Random(12)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    p, q = new(60), new(60)
    older = [w if i % 4 else "older" for i, w in enumerate(q)]
    texts = [*([*new(30), *p[i : i + 20], *new(30)] for i in (0, 20, 40)), [*new(20), *p, *new(20)], [*new(50), *p, *new(9)], [*new(9), *older, *new(9)], [*new(9), *q, *new(9)], [*new(40), *q, *new(40)]]
    found = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts, 1)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found} == {(5, 4), (8, 7)}
    assert all(r["similarity"] == 1.0 and r["n_words"] >= fuzzy_passages.LONG_WORDS for r in found)


def test_fuzzy_passages_find_all_long_exact_repeats(spark):
    """Every run of LONG_WORDS + LONG_WINDOW - 1 words that an earlier document holds meets a row, held against all pairs of documents."""
    rng = random.Random(13)
    pool = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(8, 70))] for _ in range(40)]
    texts = [[w for _ in range(rng.randrange(1, 7)) for w in rng.choice(pool)[: rng.randrange(4, 70)]] for _ in range(150)]
    found = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), bucket_bytes=9000).collect()
    shown = [set() for _ in texts]
    for r in found:
        shown[r["doc_id"]].update(range(r["start_word"], r["start_word"] + r["n_words"]))
        a, b = (texts[r[d]][r[s] : r[s] + r[n]] for d, s, n in (("doc_id", "start_word", "n_words"), ("source_id", "source_start", "source_words")))
        assert r["source_id"] < r["doc_id"] and r["matched_words"] == brute_lcs(a, b) >= 0.8 * max(len(a), len(b))
    length = fuzzy_passages.LONG_WORDS + fuzzy_passages.LONG_WINDOW - 1
    seen, n = set(), 0
    for d, t in enumerate(texts):
        runs = [tuple(t[i : i + length]) for i in range(len(t) - length + 1)]
        for i, run in enumerate(runs):
            if run in seen:
                n += 1
                assert len(shown[d] & set(range(i, i + length))) >= fuzzy_passages.LONG_WORDS
        seen.update(runs)
    assert n > 300


def test_fuzzy_passages_recall_of_edited_copies(spark):
    """Passages of 60 words with every tenth word changed, of which earlier documents hold parts of 5 to 15 words; exact ones are all found."""
    rng = random.Random(15)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    planted = [new(60) for _ in range(60)]
    parts, firsts, copies = [], [], []
    for i, p in enumerate(planted):
        at = rng.randrange(45)
        parts.append([*new(30), *p[at : at + rng.randrange(5, 16)], *new(30)])
        firsts.append([*new(20), *p, *new(20)])
        copies.append([*new(9), *(w if i % 2 or k % 10 else f"{w}x" for k, w in enumerate(p)), *new(9)])
    texts = [*parts, *firsts, *copies]
    found = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    pairs = {(r["doc_id"] - 120, r["source_id"] - 60) for r in found}
    assert all(i == k for i, k in pairs)
    assert sum((i, i) in pairs for i in range(1, 60, 2)) == 30 and sum((i, i) in pairs for i in range(0, 60, 2)) >= 27


def all_pairs(texts):
    """Passages by every seed that two documents share, at all its places: what no choice of partners may lose."""
    own = []
    for t in texts:
        words = fuzzy_passages.word_hashes(" ".join(t).encode())
        h, at, n = fuzzy_passages.seeds(words)
        m = fuzzy_passages.apart(words, h[:n], at[:n])
        own.append((h[:n][m].tolist(), at[:n][m].tolist()))
    out = []
    for d, (h, x) in enumerate(own):
        for s in range(d):
            places = {}
            for g, y in zip(*own[s], strict=True):
                places.setdefault(g, []).append(y)
            both = sorted((a, y) for g, a in zip(h, x, strict=True) for y in places.get(g, []))
            for c in fuzzy_passages.chains([a for a, _ in both], [y for _, y in both]):
                cx, cy = [both[i][0] for i in c], [both[i][1] for i in c]
                ends = cx[-1] + 5, cy[-1] + 5
                a, b = texts[d][cx[0] : ends[0]], texts[s][cy[0] : ends[1]]
                parts = fuzzy_passages.alike_parts(a, b, [v - cx[0] for v in cx], [v - cy[0] for v in cy], 0.8, 25)
                out += [((d, cx[0] + i, k), (s, cy[0] + j, n)) for i, k, j, n, _ in parts]
    return out


def classes_of(links):
    """For a passage: the classes of the regions that it overlaps, regions being overlapping ends of rows and a class what rows link."""
    ends = sorted({e for link in links for e in link})
    region, regions = {}, []
    for d, at, n in ends:
        if regions and regions[-1][0] == d and at < regions[-1][2]:
            regions[-1][2] = max(regions[-1][2], at + n)
        else:
            regions.append([d, at, at + n])
        region[d, at, n] = len(regions) - 1
    root = list(range(len(regions)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(region[a]), find(region[b])))
        root[y] = x
    return lambda d, at, n: {find(i) for i, (own, lo, hi) in enumerate(regions) if own == d and lo < at + n and at < hi}


@pytest.mark.parametrize("most", [2, 32])
def test_fuzzy_passages_lose_no_link_of_all_pairs(spark, most):
    """Edited copies beside holders of parts and older wordings, copies, common lines: both ends of every passage of all pairs are in one class."""
    rng = random.Random(21)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, texts = new(9), []
    edited = lambda p, every: [w if rng.randrange(every) else new(1)[0] for w in p]
    for _ in range(12):
        p = new(rng.randrange(45, 80))
        cut = rng.randrange(15, 25)
        texts += [[*new(15), *p[i : i + cut], *new(15)] for i in range(0, len(p) - cut, cut)]
        texts += [[*new(8), *line, *edited(p, e), *new(8)] for e in (5, 6, 8, 10, 12, 12)] + [[*new(4), *p, *new(4)] for _ in range(3)]
    texts += [[*rng.choice(texts)[-60:], *new(3), *rng.choice(texts)] for _ in range(15)]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = fuzzy_passages.passages(df, bucket_bytes=9000, most=most).collect()
    for r in found:
        a, b = (texts[r[d]][r[s] : r[s] + r[n]] for d, s, n in (("doc_id", "start_word", "n_words"), ("source_id", "source_start", "source_words")))
        assert r["source_id"] < r["doc_id"] and r["matched_words"] == brute_lcs(a, b) and r["similarity"] == r["matched_words"] / max(len(a), len(b)) >= 0.8
    at = classes_of([((r["doc_id"], r["start_word"], r["n_words"]), (r["source_id"], r["source_start"], r["source_words"])) for r in found])
    want = all_pairs(texts)
    assert len(want) > 300 and [(a, b) for a, b in want if not at(*a) & at(*b)] == []


def test_fuzzy_passages_of_edited_copies_beside_holders_of_all_parts(spark):
    """Earlier documents have every seed of the two, and each too few of them for a passage."""
    rng = random.Random(22)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    p = new(60)
    copy = [w if i % 10 else f"{w}x" for i, w in enumerate(p)]
    parts = [[*new(9), *p[i : i + 18], *new(9)] for i in range(0, 60, 14)]
    texts = [*parts, [*new(9), *p, *new(9)], [*new(9), *copy, *new(9)]]
    found = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["source_id"]) for r in found] == [(6, 5)]


def test_fuzzy_passages_where_texts_lie_in_one_document(spark):
    """Two wordings of one document: a copy of either is linked with the other one, too."""
    rng = random.Random(23)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    p = new(60)
    q = [w if i % 10 else f"{w}x" for i, w in enumerate(p)]
    texts = [[*p, *new(200), *q], [*new(9), *p, *new(9)], [*new(9), *q, *new(9)]]
    found = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    at = classes_of([((r["doc_id"], r["start_word"], r["n_words"]), (r["source_id"], r["source_start"], r["source_words"])) for r in found])
    assert at(1, 9, 60) == at(2, 9, 60) and len(at(1, 9, 60)) == 1


def test_fuzzy_passages_of_repeated_words_are_linked_without_all_pairs(spark):
    """Texts of two words again and again have a seed at many places: they come into one class by some rows for each text, not by a row for each pair."""
    rng = random.Random(25)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [[*new(9), *["the"] * rng.randrange(13, 16), *new(1), *["of"] * rng.randrange(13, 16), *new(9)] for _ in range(60)] + [[*new(9), *["the"] * 19, *new(9)]]
    found = fuzzy_passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    at = classes_of([((r["doc_id"], r["start_word"], r["n_words"]), (r["source_id"], r["source_start"], r["source_words"])) for r in found])
    classes = [at(i, 9, len(t) - 18) for i, t in enumerate(texts)]
    assert len(set.union(*classes)) == 1 and all(classes[:60]) and not classes[60] and len(found) < 8 * len(texts)


def test_open_pairs_against_all_pairs():
    """Each pair of texts belongs to one seed, in one group or in blocks of a few texts, and those that could hold a passage all come."""
    rng = random.Random(26)
    least, short = 25, fuzzy_passages.shortest(25, 0.8)
    for blocks in (1, 3):
        texts = [{s: (lo := rng.randrange(40), lo + rng.randrange(9), rng.choice([None, 1, 1, 2])) for s in rng.sample(range(-9, 9), rng.randrange(1, 9))} for _ in range(60)]
        got = []
        for seed in range(-9, 9):
            own = [i for i, t in enumerate(texts) if seed in t]
            for p in range(blocks):
                for q in range(p, blocks):
                    mine = [i for i in own if i % blocks in (p, q)]
                    if not mine:
                        continue
                    h, lo, hi, label = zip(*((s, a, b, c) for i in mine for s, (a, b, c) in texts[i].items()), strict=True)
                    owner = np.repeat(np.arange(len(mine)), [len(texts[i]) for i in mine])
                    left = np.array([k for k, i in enumerate(mine) if i % blocks == p], int)
                    right = left if p == q else np.array([k for k, i in enumerate(mine) if i % blocks == q], int)
                    a, b = fuzzy_passages.open_pairs(seed, owner, np.array(h), np.array(lo), np.array(hi), np.array([c or 0 for c in label]), np.array([c is not None for c in label]), left, right, 0.8, least, p == q)
                    got += [tuple(sorted((mine[left[x]], mine[right[y]]))) for x, y in zip(a, b, strict=True)]
        want = []
        for i, j in ((i, j) for j in range(len(texts)) for i in range(j)):
            free = [s for s in texts[i] if s in texts[j] and (texts[i][s][2] is None or texts[i][s][2] != texts[j][s][2])]
            spans = [max(t[s][1] for s in free) + 5 - min(t[s][0] for s in free) for t in (texts[i], texts[j]) if free]
            if spans and max(spans) >= least and min(spans) >= short:
                want.append((i, j))
        assert sorted(got) == sorted(want) and len(want) > 100


def test_stretches_hold_every_chain():
    rng = random.Random(24)
    for _ in range(200):
        x = sorted(rng.sample(range(200), 14))
        y = [sum(1 for a in x if a <= b) for b in x]  # as near to one another as can be in the other text
        runs = fuzzy_passages.stretches(np.array(x), 0)
        for c in fuzzy_passages.chains(x, y):
            assert any(lo <= c[0] and c[-1] < hi for lo, hi in runs)
        assert fuzzy_passages.stretches(np.array(x), 40) == [(lo, hi) for lo, hi in runs if x[hi - 1] + 5 - x[lo] >= 40]


def test_fuzzy_passages_of_repeated_ids(spark):
    """Each text of an id is a source of its own, however rows are cut into tasks; beyond the bound of what is broadcast as well."""
    rng = random.Random(14)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    p, q, r = new(60), new(60), new(60)
    rows = [(5, p), (5, q), (5, q), (5, None), (None, r), (None, [*r, *q]), *((i, [*new(5), *(p if i % 2 else q)]) for i in range(10, 22)), (7, new(60)), (7, new(60))]
    df = spark.createDataFrame([(i, None if t is None else " ".join(t)) for i, t in rows], "doc_id long, text string")
    results = [order([tuple(x) for x in fuzzy_passages.passages(df.repartition(k)).collect()]) for k in (1, 3, 8)]
    assert results[0] == results[1] == results[2]
    assert sorted((x[0] or 99, x[3], x[7]) for x in results[0]) == [*((i, 5, 1.0) for i in range(10, 22)), (99, 5, 1.0)]
    own = fuzzy_passages.tagged(numbered(df)).collect()
    assert {x["doc_id"] for x in own if x["tag"]} == {5, 7, NO_ID} and all(x["tag"] for x in fuzzy_passages.tagged(numbered(df), most=1).collect())


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_chains_against_quadratic_programming():
    rng = random.Random(4)
    for _ in range(60):
        pts = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(14)})
        x, y = [p[0] for p in pts], [p[1] for p in pts]
        best = []
        for i, (a, b) in enumerate(pts):
            best.append(1 + max([0.0] + [best[j] - 0.05 * (a - pts[j][0] + b - pts[j][1]) for j in range(i) if pts[j][0] < a and pts[j][1] < b]))
        got = fuzzy_passages.chains(x, y)
        top = got[0] if got else []
        score = len(top) - 0.05 * (x[top[-1]] - x[top[0]] + y[top[-1]] - y[top[0]]) if top else 0
        assert score == pytest.approx(max(best)) or max(best) < 2


# --- 9


def test_compression_classifier(spark, docs, empty):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "walked", "under", "bright", "morning"]) for _ in range(120))
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "***", "NOW!!", "%%%", "FREE!!"]) for _ in range(120))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)] + [(1000, None), (1001, "")]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(400)] + [(3, None), (5, 7)], "doc_id long, quality int")
    model = compression_classifier.fit(own, labels, F.col("doc_id") < 300)
    got = {r["doc_id"]: r["score"] for r in compression_classifier.score(own, model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 4 != 0) for i in range(300, 400)]) >= 0.97 and all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001] == model.base
    assert compression_classifier.score(empty, model).count() == 0
    none = compression_classifier.fit(own, labels, F.lit(False))
    assert {r["score"] for r in compression_classifier.score(docs, none).collect()} == {0.5}


# --- 10


def test_top_k(spark):
    import duckdb

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(300)]
    rows += [(300, rows[0][1]), (350, rows[0][1]), (301, None), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (400, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 50 == 0, shard=40, block=3).collect())
    embeddings = df.toPandas()  # noqa: F841  (read by name)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(con.execute(OP10_SQL).fetchall())
    assert top_k.top_k(df.limit(0), F.lit(True)).count() == 0 and top_k.top_k(df.limit(2), F.lit(True)).count() == 2


@pytest.mark.parametrize("shard", [2048, 7])
def test_top_k_merges_rows_of_one_id(spark, shard):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, 4)]) for i in range(40)] * 2
    rows += [(41, [float(x) for x in rng.integers(20, 30, 4)]) for _ in range(12)] + [(42, [-x for x in v]) for _, v in rows[:3]]
    rows += [(0, [1.0, 2.0, 3.0, 4.0]), (1, [9.0, 9.0, 9.0, 9.0]), (43, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = []
    for query in sorted({i for i, _ in rows if i % 10 == 0}):
        best = {}
        for q in (v for i, v in rows if i == query):
            for i, v in rows:
                if i != query and len(v) == len(q):
                    best[i] = max(best.get(i, -(10**9)), round(65536 * sum(a * b for a, b in zip(q, v, strict=True))))
        want += [(query, k, i, s) for k, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    got = top_k.top_k(df, F.col("vec_id") % 10 == 0, shard=shard, block=3).collect()
    assert sorted(tuple(r) for r in got) == want


def test_word_codec_gives_other_tokenizers_whole_texts(tmp_path):
    import json

    path = P.path("word_bpe_49k.json")
    own = packing.WordBPE(path)
    odd = ["a.b,c .x _., a_. ._ don't IT'S x'll <|endoftext|> İstanbul ΣΑΣ é é 1,000.5 ...", "\x1c a", "", " \n", "日本語 🧾, x", "ß ﬁ Ǆ a,b", "x y z\u0085w", "ab " * 3000]
    assert own.by_word and own.encode_batch(odd) == own.whole(odd)
    spec = json.load(open(path, encoding="utf-8"))
    spec["normalizer"] = {"type": "NFC"}  # letters keep their case: not what the word path is made for
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    other = packing.WordBPE(str(tmp_path / "cased.json"))
    assert not other.by_word and other.encode_batch(["Some Words", "some words"]) == other.whole(["Some Words", "some words"])


# --- null and repeated ids


@pytest.fixture(scope="module")
def odd_rows():
    """Null ids, one id with equal and with unlike texts, and copies under several ids."""
    rng = random.Random(9)
    new = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing."]) + str(rng.randrange(40)) for _ in range(n))
    a, b, c, d, e = (new(90) for _ in range(5))
    return [(5, a), (5, a), (5, b), (None, a), (None, c), (None, c), (None, None), (8, None), (9, c + " " + d), (3, e), (7, d + " " + e), (5, "")]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, "doc_id long, text string").withColumn("_id", F.lit("clash")).withColumn("_key", F.lit("clash")).repartition(3)


def removed_bytes(rows, length=50):
    """doc_id, bytes kept of each row by the definition, a null id after all others."""
    last = float("inf")
    first = {}
    for d, t in rows:
        raw, own = (t or "").encode(), last if d is None else d
        for i in range(len(raw) - length + 1):
            first[raw[i : i + length]] = min(own, first.get(raw[i : i + length], last))
    out = []
    for d, t in rows:
        raw, own = (t or "").encode(), last if d is None else d
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < own:
                gone[i : i + length] = [True] * length
        out.append((d, bytes(x for x, g in zip(raw, gone, strict=True) if not g)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_row_by_row_operators_with_null_and_repeated_ids(odd, odd_rows, spark):
    ids = order([(d,) for d, _ in odd_rows])
    of = lambda df: order([(r["doc_id"],) for r in df.select("doc_id").collect()])
    assert of(ppm.score(odd, fold(5) != 1, order=2)) == ids
    assert of(quality_rules.judge(odd)) == ids
    assert of(byte_bpe.round_trip(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)) == ids
    assert of(pii.pseudonymise(odd, "k")) == ids
    labels = spark.createDataFrame([(3, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    assert of(compression_classifier.score(odd, compression_classifier.fit(odd, labels, F.lit(True)))) == ids
    pieces = packing.pack(packing.pieces(odd, P.path("word_bpe_49k.json"))).collect()
    assert order([(r["doc_id"],) for r in pieces if r["piece"] == 0]) == ids
    a, c, d, e = (odd_rows[i][1] for i in (0, 4, 8, 9))
    own = lambda t: len(t.split())
    got = {(r["doc_id"], r["source_id"]): r["similarity"] for r in fuzzy_passages.passages(odd).collect()}
    assert set(got) == {(7, 3), (9, 7), (None, 5), (None, 9)} and set(got.values()) == {1.0} and own(a) == own(c) == own(e) == 90 and own(d) == 180


def test_suffix_dedup_with_null_and_repeated_ids(odd, odd_rows):
    want = removed_bytes(odd_rows)
    got = substring_dedup.removal(odd).collect()
    assert order([(r["doc_id"], r["n_bytes"] - r["n_removed"], r["kept_sha256"]) for r in got]) == order([(d, len(x), hashlib.sha256(x).hexdigest()) for d, x in want])
    kept = [None if t is None else x.decode() for (_, t), (_, x) in zip(odd_rows, want, strict=True)]
    out = substring_dedup.deduplicated(odd)
    assert out.columns == odd.columns and order([(r["doc_id"], r["text"]) for r in out.collect()]) == order([(d, x) for (d, _), x in zip(odd_rows, kept, strict=True)])


def test_simhash_with_null_and_repeated_ids(odd, odd_rows):
    last = (1 << 63) - 1
    prints = [brute_print(t) for _, t in odd_rows]
    group = list(range(len(prints)))
    for i, x in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j]).bit_count() <= 4:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    low = {g: min(last if odd_rows[i][0] is None else odd_rows[i][0] for i in range(len(group)) if group[i] == g) for g in group}
    want = [(d, f"{x:016x}", None if low[g] == last else low[g]) for (d, _), x, g in zip(odd_rows, prints, group, strict=True)]
    got = simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect()
    assert order([tuple(r) for r in got]) == order(want)


def test_stages_with_null_and_repeated_ids(odd, odd_rows):
    good = {t for _, t in odd_rows if t}
    kept = quality_rules.keep(odd)
    verdict = {r["text"] for r in quality_rules.judge(odd.withColumn("own", F.col("text")), "own").filter("kept").select(F.col("own").alias("text")).collect()}
    assert order([(r["doc_id"], r["text"]) for r in kept.collect()]) == order([r for r in odd_rows if r[1] in verdict]) and verdict <= good and kept.columns == odd.columns
    left = simhash.representatives(odd)
    assert left.columns == odd.columns
    a, b, c, d, e = (odd_rows[i][1] for i in (0, 2, 4, 10, 9))
    assert order([(r["doc_id"], r["text"]) for r in left.collect()]) == order([(5, a), (5, b), (5, ""), (None, c), (9, odd_rows[8][1]), (3, e), (7, d)])


# --- many buckets, long texts


def test_many_buckets_give_the_same_results(docs, rows, spark):
    """The exchange between buckets and parts, which one bucket never reaches."""
    want = {d: (len((t or "").encode()) - len(x), hashlib.sha256(x).hexdigest()) for (d, t, *_), (_, x) in zip(rows, removed_bytes([r[:2] for r in rows]), strict=True)}
    for hot in (2, 20000):
        got = substring_dedup.removal(docs, hot=hot, bucket_bytes=3000).collect()
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in got} == want
    scores = lambda df: {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 4)) for r in df.collect()}
    assert scores(ppm.score(docs, fold(5) != 1, bucket_bytes=3000)) == scores(ppm.score(docs, fold(5) != 1))
    found = lambda df: sorted(tuple(r) for r in df.collect())
    assert found(fuzzy_passages.passages(docs, bucket_bytes=3000)) == found(fuzzy_passages.passages(docs)) != []


def test_texts_longer_than_a_chunk(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, n))
    a, b = words(220_000), words(120_000)
    at = (1 << 20) - 100  # the copy lies across the edge of a chunk
    text = b[:at] + "~" + a[at : at + 400] + "~" + b[at:]
    df = spark.createDataFrame([(1, a), (2, text), (3, "short")], "doc_id long, text string")
    got = by_id(substring_dedup.removal(df))
    assert len(a) > 2 << 20 < 2 * len(text) and [got[d]["n_removed"] for d in (1, 2, 3)] == [0, 400, 0]
    assert got[2]["kept_sha256"] == hashlib.sha256((b[:at] + "~~" + b[at:]).encode()).hexdigest()
    score = by_id(ppm.score(df, F.col("doc_id") != 3, order=2))
    assert score[1]["n_tokens"] == 220_001 and all(-1e8 < r["score"] < 0 for r in score.values())
    pieces = packing.pieces(df, P.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).collect()
    assert all(r["most"] <= 2048 for r in pieces) and len(pieces) == 3
    fps = by_id(simhash.near_duplicates(df))
    assert fps[1]["fingerprint"] == f"{brute_print(a):016x}"


def test_classifier_scores_equal_the_formula(spark):
    import zstandard

    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(40, 90))) + "."
    bad = lambda: " ".join(rng.choice(["CLICK", "$$$", "win", "now!!", "free"]) for _ in range(rng.randint(20, 60)))
    texts = [(i, good() if i % 2 else bad()) for i in range(200)] + [(900, ""), (901, None), (None, good())]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("quality", F.lit("clash")).withColumn("_hash", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(120)], "doc_id long, quality int, text string")
    model = compression_classifier.fit(df, labels, F.col("doc_id") < 100)
    sizes = [[len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_content_size=False, write_dict_id=False).compress((t or "").encode())) for d in model.dictionaries] for _, t in texts]
    got = compression_classifier.score(df, model).collect()
    want = []
    for (i, t), (x, y) in zip(texts, sizes, strict=True):
        n = max(1, len((t or "").encode()))
        z = sum(w * f for w, f in zip(model.weights, (1, 100 * (x - y) / n, (x - y) / math.sqrt(n), min(x, y) / n, math.log(n)), strict=True))
        want.append((i, round(1 / (1 + math.exp(-z)) if t else model.base, 6)))
    assert order([(r["doc_id"], round(r["score"], 6)) for r in got]) == order(want)
    held = {r["doc_id"]: r["score"] for r in got if r["doc_id"] is not None and 120 <= r["doc_id"] < 200}
    assert sum((s > 0.5) == (i % 2 == 1) for i, s in held.items()) >= 0.9 * len(held)
    few = compression_classifier.fit(df, labels, F.col("doc_id") < 100, sample_bytes=4000)
    assert 0 < len(few.dictionaries[0]) + len(few.weights) and compression_classifier.fit(df, labels.limit(0), F.lit(True)).weights == ()


def test_unlike_fingerprints_that_share_an_id_stay_apart(spark):
    """Null and repeated ids are no bridge between groups; against links over rows."""
    rng = random.Random(12)

    def near(text, least=1):
        own = text.split()
        while True:
            x = list(own)
            x[rng.randrange(len(x))] = rng.choice(WORDS)
            if least <= (brute_print(text) ^ brute_print(" ".join(x))).bit_count() <= 4:
                return " ".join(x)

    one, two, three = (" ".join(rng.choice(WORDS) for _ in range(400)) for _ in range(3))
    rows = [(3, one), (None, near(one)), (9, two), (None, near(two)), (50, near(one)), (50, near(two)), (50, three), (None, three), (60, "a b c d e"), (None, "f g h i j")]
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert order((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == order((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True))
    assert {least[g] for g in group} >= {3, 9, 50, 60}
