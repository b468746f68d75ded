"""Extraction against a plain scanner, on edge cases and seeded random documents."""

import random
import re

from pyspark.sql import functions as F

from attestra.operators import extract

SPACES = "\t\n\x0b\x0c\r\x85      　 " + "".join(map(chr, range(0x2000, 0x200B)))
EDGE = [
    "", "   ", "One two three four.", "One two three four", "One two three four\nnext line has words enough.", "One two three four\n", "One two three four\r\n",
    "Is this a question for you? Yes it is here!", "He paid the rent today and she kept the house open.", "He ran and she hid in the house.", "A b c d... e f g h!? i j k l",
    "The court 🧾 granted the motion AND the clerk filed the order.", "Please note that this is some text.", "We paid rent but   they kept but all of it here.", "x.\n\ny z w v u.", ".", "...", "\n\n",
]


def scan(text):
    """Sentences as (start, end, raw) in UTF-16 units."""
    final = re.search(r"(\r\n|[\n\r\x85  ])\Z", text)
    ends = {len(text)} | ({final.start()} if final else set())
    out, i = [], 0
    while i < len(text):
        if text[i] in ".!?\n":
            i += 1
            continue
        j = i
        while j < len(text) and text[j] not in ".!?\n":
            j += 1
        k = j
        while k < len(text) and text[k] in ".!?":
            k += 1
        if k > j:
            stop = k
        else:
            stop = max((e for e in ends if i < e <= j), default=None)
        if stop is None:
            i = j
            continue
        out.append((i, stop))
        i = stop
    unit = lambda n: len(text[:n].encode("utf-16-be")) // 2
    return [(unit(a), unit(b), text[a:b]) for a, b in out]


def test_sentences_match_the_scanner(spark):
    rng = random.Random(7)
    bits = ["word", "and", "but", " ", " ", "  ", "\n", "\r\n", ".", "!", "?", "🧾", "é", " ", "and ", " but ", "The court ", "paid rent"]
    texts = EDGE + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", extract.sentences(F.col("text")).alias("s"))
    got = {r["doc_id"]: [(x["start_utf16"], x["end_utf16"], x["raw"]) for x in r["s"]] for r in df.collect()}
    for i, t in enumerate(texts):
        assert got[i] == scan(t), repr(t)


def claims(spark, text):
    return extract.claims(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ordinal").collect()


def test_clauses_and_ids(spark):
    rows = claims(spark, "Hi there. He paid the rent and she kept the house.")
    assert [(r["claim_id"], r["text"], r["parent_text"]) for r in rows] == [
        ("claim-9-0", "He paid the rent", "He paid the rent and she kept the house."),
        ("claim-9-1", "she kept the house.", "He paid the rent and she kept the house."),
    ]
    assert [r["parent_text"] for r in claims(spark, "He ran and she hid in the house.")] == [None]


def test_material_gate(spark):
    assert claims(spark, "Is this a question for you? Too short. Please note that it rains here. 1 2 3 4.")[0]["text"] == "1 2 3 4."


def test_types(spark):
    want = {
        "Recommend that we go on now.": "recommendation", "She recommends that we go now.": "recommendation", "It is therefore true for all.": "legalConclusion", "The law requires a long notice.": "legalRule",
        "The sum equals four of them.": "calculation", 'He said "no" to all of it.': "quotation", "The sky is very blue.": "factual", "This law requires, therefore it is.": "legalConclusion",
    }
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", extract.claim_type(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in df.collect()} == want


def test_null_and_empty_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert extract.claims(df).count() == 0


def test_running_sums_and_many_sentences(spark):
    for n in (0, 1, 2, 3, 10, 1000):
        got = spark.range(1).select(extract.running_sums(F.transform(F.sequence(F.lit(1), F.lit(max(n, 1))), lambda i: i.cast("int")) if n else F.array().cast("array<int>")).alias("x")).first()["x"]
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]
    text = ("The court granted it. " * 20000).strip()
    last = extract.sentence_rows(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy(F.desc("sentence_ordinal")).first()
    assert (last["sentence_ordinal"], last["start_utf16"], last["end_utf16"]) == (19999, 22 * 19999 - 1, len(text))
