"""Whitening, fill-in-middle and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import decontamination, fill_in_middle, whitening
from tests.llm.conftest import WORDS, prose

# --- 11


def exact(vectors):
    """Deviation, whitened rows (up to sign), explained: from all rows at once."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    y = n * x - s
    c = (y / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (y**2).sum(axis=1), (c @ u / np.sqrt(e))[:, ::-1], e[::-1] / max(e.sum(), 1e-300)


def whitened(df, **kw):
    out = {}
    for r in whitening.transform(df, whitening.fit(df, **kw)).collect():
        out.setdefault(r["vec_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in out.items()}


def test_whitening_equals_the_decomposition_of_all_rows(spark):
    rng = np.random.default_rng(2)
    own = [(i, v) for i, v in enumerate((rng.normal(size=(300, 12)) * np.arange(1, 13) + 3).astype(np.float32).tolist())]
    odd = [(1000, None), (1001, [None] + [1.0] * 11), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (1004, [])]
    df = spark.createDataFrame(own + odd, "vec_id long, embedding array<float>").withColumns({"component": F.lit("clash"), "n": F.lit(1)}).repartition(7)
    got = whitened(df)
    assert set(got) == {i for i, _ in own} and all([r["component"] for r in v] == list(range(1, 9)) for v in got.values())
    deviation, z, explained = exact([v for _, v in own])
    assert [int(got[i][0]["deviation"]) for i, _ in own] == deviation.tolist()
    mine = np.array([[r["whitened"] for r in got[i]] for i, _ in own])
    signs = np.sign((mine * z[:, :8]).sum(axis=0))
    assert np.abs(mine * signs - z[:, :8]).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[0]], explained[:8], rtol=1e-9) and got[0][0]["n"] == 300
    assert {r["identity_error"] for v in got.values() for r in v} == {got[0][0]["identity_error"]} and got[0][0]["identity_error"] < 1e-9


def test_merging_is_exact_for_far_means_and_large_numbers(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 50, (500, 5)) + 10**12
    parts = [whitening.of_rows(x[a:b]) for a, b in ((0, 1), (1, 2), (2, 250), (250, 500))]
    whole = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    c = (500 * x - x.sum(axis=0)) / 500
    assert whole.n == 500 and whole.sums == x.sum(axis=0).tolist() and np.allclose(whole.scatter, c.T @ c, rtol=1e-12)
    big = [(i, [float(v) for v in row]) for i, row in enumerate(rng.integers(-(2**46), 2**46, (40, 3)).tolist())]
    got = whitened(spark.createDataFrame(big, "vec_id long, embedding array<double>"))
    assert [int(got[i][0]["deviation"]) for i, _ in big] == exact([v for _, v in big])[0].tolist()
    with pytest.raises(Exception, match="62 bits"):
        whitened(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"))


def test_whitening_of_few_and_odd_rows(spark):
    schema = "vec_id long, embedding array<double>"
    none = spark.createDataFrame([], schema)
    assert whitening.fit(none) == {} and whitening.transform(none, {}).count() == 0
    one = whitened(spark.createDataFrame([(1, [0.5, 2.0])], schema))
    assert [(r["whitened"], r["explained"], int(r["deviation"])) for r in one[1]] == [(0.0, 0.0, 0)] * 2
    flat = whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(20)], schema))
    assert all(r["identity_error"] < 1e-9 for v in flat.values() for r in v) and flat[3][0]["explained"] == pytest.approx(1)
    assert all(r["whitened"] == 0 for v in flat.values() for r in v[1:])
    lengths = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(15)] + [(100 + i, [float(i)]) for i in range(9)] + [(None, [3.0]), (100, [5.0])], schema)
    rows = whitening.transform(lengths, whitening.fit(lengths)).collect()
    assert {(r["n"], r["component"]) for r in rows} == {(15, 1), (15, 2), (11, 1)} and len(rows) == 41


# --- 12


def brute_cut(doc_id, text, seed=7, unit=r"[^\n]*\n|[^\n]+", fim=100, spm=50):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < spm
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def order(rows):
    return sorted(rows, key=repr)


def test_fill_in_middle(spark, docs, rows, empty):
    more = [(5001, "a <P> b\nc\n", "", "", 1), (5002, "x<\nS>\n<M\n>y", "", "", 1), (5003, "\n\n\n", "", "", 1), (5004, "\r\n one\r\ntwo three", "", "", 1), (5005, "<" * 50 + "\n" + ">" * 50, "", "", 1)]
    odd = [(None, "one\ntwo\nthree\n", "", "", 1), (None, "four\nfive", "", "", 1), (None, None, "", "", 1), (rows[4][0], "another\ntext\nof one id\n", "", "", 1), *rows[4:6], rows[4]]
    every = [*rows, *more, *odd]
    df = spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("key", "low", "high", "output", "form", "digest", "others", "ordinal")}).repartition(3)
    for kw in ({}, {"seed": 11, "fim": 60, "spm": 0}, {"seed": 3, "spm": 100, "unit": r"[^ ]* |[^ ]+"}):
        out = fill_in_middle.transform(df, kw.get("seed", 7), kw.get("unit", fill_in_middle.LINE), kw.get("fim", 100), kw.get("spm", 50))
        got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        assert order((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == order((d, t, *brute_cut(d, t, **kw)) for d, t, *_ in every)
        assert all(r["back"] == (r["text"] or "") for r in got) and {r["form"] for r in got} >= {"plain"}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "low", "high", "digest", "others", "ordinal", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fill_in_middle.transform(empty).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.transform(df, markers=("<A", "A<", "<M>"))


def test_fill_in_middle_of_many_units_and_copies(spark):
    text = "".join(f"line {i}\n" for i in range(40_000))
    df = spark.createDataFrame([(1, text)] * 3 + [(2, text)], "doc_id long, text string")
    got = fill_in_middle.transform(df).collect()
    assert order(tuple(r)[2:] for r in got) == order([brute_cut(1, text)] * 3 + [brute_cut(2, text)])


# --- 13


def tokens(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))


def brute_leaks(texts, items, size=10):
    windows, out = {}, []
    for name, t in items:
        w = tokens(t)
        k = min(size, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add("" if name is None else str(name))
    sizes = sorted({len(w) for w in windows})
    for t in texts:
        w, hit, names = tokens(t), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    names |= own
        out.append((len(w), len(hit), tuple(sorted(names))))
    return out


def leaks(df, items, **kw):
    return decontamination.contamination(df, items, **kw).collect()


def planted(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 12, 10, 9, 3, 1, 60, 25))]
    items += [(100, None), (101, " .,- "), (102, items[0][1]), (1, items[7][1]), (None, prose(rng, 15)), (103, "É" * 30 + " ünïcode wörds 日本語 " * 5), (104, "averyveryverylongword" * 9 + " and " + prose(rng, 11))]
    of = dict(items)
    part = lambda i, a, b: " ".join(of[i].split()[a:b])
    texts = [of[0], "x " + part(0, 5, 30) + " y", part(0, 5, 14), part(0, 5, 15).upper() + "!!", of[3], part(3, 0, 8), "the " + of[4] + " end", "nothing to see", None, "", of[103] + "\n" + of[104], of[6][:-3] + " " + of[6],
             *[prose(rng, 200) for _ in range(10)], " ".join(rng.choice(WORDS) for _ in range(3000)), *[prose(rng, 30) + " " + of[7] + " " + prose(rng, 30)] * 40, (of[1] + " ") * 50]
    return texts, items


def test_contamination_equals_brute_force(spark):
    for seed in (1, 2):
        texts, items = planted(seed)
        df = spark.createDataFrame([(i % 60, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, hits string, n int").repartition(4)
        b = spark.createDataFrame(items, "item_id long, text string")
        for kw in ({}, {"window": 3}, {"block": 800}):
            got = leaks(df, b, **kw)
            mine = order((r["text"], r["n_words"], sum(h["length"] for h in r["hits"]), tuple(r["items"])) for r in got)
            assert mine == order((t, *x) for t, x in zip(texts, brute_leaks(texts, items, kw.get("window", 10)), strict=True))
            for r in got:
                spans = [(h["start"], h["start"] + h["length"]) for h in r["hits"]]
                assert all(a[1] < c[0] for a, c in zip(spans, spans[1:], strict=False)) and all(0 <= a < c <= r["n_words"] for a, c in spans)
        left = decontamination.clean(df, b)
        assert left.columns == df.columns
        assert order(r["text"] for r in left.collect()) == order(t for t, x in zip(texts, brute_leaks(texts, items), strict=True) if not x[1])
    nothing = leaks(df, b.limit(0)) + leaks(df, b.filter("item_id in (100, 101)"))
    assert len(nothing) == 2 * len(texts) and not any(r["hits"] or r["items"] for r in nothing) and max(r["n_words"] for r in nothing) >= 3000
    assert leaks(df.limit(0), b) == []


def test_longest_matches(spark):
    texts, items = planted(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    own = [(i, t) for i, t in items if i in (0, 6, 7, 104)]
    got = {(r["item_id"], r["item_word"]): (r["n_words"], r["doc_id"], r["doc_word"]) for r in decontamination.longest_matches(df, spark.createDataFrame(own, "item_id long, text string")).collect()}
    streams = [tokens(t) for t in texts]
    for i, t in own:
        w, before = tokens(t), 0
        for s in range(len(w)):
            best = (0, 0, 0)
            for d, x in enumerate(streams):
                for p in range(len(x)):
                    n = 0
                    while s + n < len(w) and p + n < len(x) and w[s + n] == x[p + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, d, p)
            if best[0] >= 10 and best[0] >= before:
                assert got[str(i), s] == best
            before = best[0]
    assert got["0", 0][0] == 40 and got["6", 0][0] == 60


def test_a_word_with_the_key_of_another_is_found_out(spark, monkeypatch):
    """A foreign word that has the key of an item's word fills its place until bytes are compared."""
    texts, items = planted(4)
    items = [i for i in items if i[1]]
    own = items[0][1].split()
    texts = [*texts, " ".join([*own[:20], "zqzq", *own[21:]]), "zqzq zqzq " + items[0][1]]
    plain = decontamination.keys
    word = tokens(own[20])[0]
    same = plain(word, np.array([0]), np.array([len(word)]))[0]

    def clashing(text, starts, sizes):
        foreign = np.array([text[a : a + n] == b"zqzq" for a, n in zip(starts, sizes, strict=True)], bool)
        return np.where(foreign, same, plain(text, starts, sizes))

    monkeypatch.setattr(decontamination, "keys", clashing)
    suite = decontamination.Suite.of(sorted((str(i), t.encode()) for i, t in items), 10)
    ends = np.cumsum([len((t or "").encode()) + 1 for t in texts]) - 1
    found, _, first = decontamination.search(suite, b"".join((t or "").encode() + b"\0" for t in texts), ends)
    got = [int(found.covered[a : b - 1].sum()) for a, b in zip(first, first[1:], strict=False)]
    assert got == [x[1] for x in brute_leaks(texts, items)] and got[-2] == len(tokens(items[0][1])) - 1
