import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", ","]) + rng.choice(["", "", "", "."]) for _ in range(n))


def make(seed: int = 3) -> list[tuple]:
    """Documents with nulls, empty and very long texts, copies, near copies, shared passages and ties."""
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (3, 30, 120, 400, 400, 90, 60, 1)]
    passage = prose(rng, 70)
    edited = base[3].split()
    for i in range(0, len(edited), 130):
        edited[i] = "changed"
    texts = [
        *base, None, "", "   \n\t ", base[3], base[3], " ".join(edited), base[1] + "\n" + passage, passage + "\n" + base[5], "x " + passage[10:-10] + " y", "AAA " * 40, "é" * 60 + base[2][:80], base[2][:80],
        "line one here\nline one here\nother\n\nother\n", "word " * 5000, "日本語 🧾 text", base[7], "tail-less" * 12, "CARD 4539578763621486 a.b@c.org " + base[6],
    ]
    return [(i * 7 % 1009, t, "en", "src0" if i % 3 else "src1", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return make()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("bucket", "fp", "kept", "component", "_source", "score", "train", "length", "_bucket", "id")
    return df.withColumns({c: F.lit("clash") for c in extra}).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
