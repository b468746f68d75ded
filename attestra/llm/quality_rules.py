"""Quality rules by weak supervision, in DataFrame operations alone.

Each rule looks at one measure of a text and votes good (1), bad (-1) or abstains
(0).  Expectation-maximisation over the table of vote patterns estimates the share of
good documents and how often each rule abstains, and is right, in either class; the
posterior probability of the good class decides, in place of a demand that every rule
passes.  Beliefs count as much as PSEUDO documents, so they vanish in a corpus.  One
thing data alone cannot tell, what a sign of junk means that never occurs together with
another: there a bound holds, that such a sign is wrong about at most FALSE_ALARMS of
the good documents.

The pattern table has at most 3^6 = 729 rows whatever the input, so only it reaches
the driver; measures are computed once, narrowly, row by row.  Windows of three
words are compared within the row by sorted 64-bit hashes, so a text of any length
costs n log n.

Defined results: a null or empty text has no words, fails the base rule and is not
kept; a null doc_id is one like any other; repeated rows get equal results; columns besides doc_id and text are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import checkpoint, text_key, texts

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Posterior probability of the good class from which a document is kept.
KEEP_FROM = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once: a lambda variable is not computed again for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more in the text, first included."""
    window = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        count = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(pairs, lambda s: let(starts(s), count))

    found = let(window, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(found)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, BLANKS)) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measures(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id and the columns ``keys``, the counts of the base rules, and the measures of the other rules."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    per_text = texts(docs, *keys).select(
        "doc_id",
        *keys,
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("w"),
        F.length(_without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        (F.length(F.regexp_replace("text", "[^\n]", "")) + 1).cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")).cast("long").alias("n_capitals"),
        (F.length("text") - F.length(_without(F.col("text"), ".!?"))).cast("long").alias("n_stops"),
    )
    n, r = F.col("w.n"), F.col("w.r")
    return per_text.select(
        "doc_id", *keys, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), "n_lines", "n_capitals", "n_stops",
        ((n < 50) | (100 * r > 50 * n)).alias("base_failed"),
    )


def _vote(good: Column | None, bad: Column) -> Column:
    vote = F.when(bad, F.lit(-1))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(0))


def votes() -> dict[str, Column]:
    """The rules.  Measures are shares of words, characters or lines; without words only length votes.

    Length, word length and stop marks vote either way.  Signs of junk (symbols,
    capitals, repetition) vote bad or abstain: their absence says little.
    """
    n, chars = F.col("n_words").cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    share = lambda x, of: F.when(n > 0, F.col(x) / of)
    mean, stops = F.when(n > 0, chars / n), share("n_stops", n)
    repeats, lines = share("n_repeat_words", n), share("n_dup_lines", F.col("n_lines").cast("double"))
    return {
        "length": _vote(n >= 80, n < 50),
        "word_length": _vote((mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 12)),
        "stops": _vote((stops >= 0.03) & (stops <= 0.35), (stops > 0.6) | (stops < 0.005)),
        "symbols": _vote(None, share("n_symbols", n) > 0.1),
        "capitals": _vote(None, share("n_capitals", chars) > 0.3),
        "repeats": _vote(None, (repeats > 0.4) | (lines > 0.5)),
    }


#: What is believed of a rule's votes before data, by class (0 bad, 1 good) and vote.
TWO_SIDED = ({-1: 0.2, 0: 0.15, 1: 0.65}, {-1: 0.05, 0: 0.15, 1: 0.8})
ONE_SIDED = ({-1: 0.4, 0: 0.6, 1: 1e-9}, {-1: 0.005, 0: 0.995, 1: 1e-9})
BELIEFS = (TWO_SIDED,) * 3 + (ONE_SIDED,) * 3
#: Share of good documents to begin with, documents that beliefs count as, and the bound on false alarms of one-sided rules.
BALANCE, PSEUDO, FALSE_ALARMS = 0.8, 50.0, 0.0002


@dataclass
class Estimate:
    """The posterior of the good class by pattern, the share of good documents, and each rule's rate of each vote by class (0 bad, 1 good)."""

    posterior: dict[tuple[int, ...], float]
    balance: float
    rates: list[list[dict[int, float]]]


def estimate(patterns: list[tuple[tuple[int, ...], int]], beliefs: tuple = BELIEFS, balance: float = BALANCE, pseudo: float = PSEUDO, false_alarms: float = FALSE_ALARMS, rounds: int = 100) -> Estimate:
    """Expectation-maximisation over vote patterns and their counts.

    Votes are independent given the class, and each rule has its own rate of each vote
    in each class.  The beliefs start the rates, which settles which class is the good
    one, and stay as ``pseudo`` documents of either class, which keeps rates above zero.
    Rules that are believed never to vote good are the one-sided ones, to which the
    bound applies.
    """
    rate = [[dict(b[side]) for b in beliefs] for side in (0, 1)]
    one_sided = [j for j, b in enumerate(beliefs) if b[1][1] < 1e-6]
    whole = sum(c for _, c in patterns)
    post: dict[tuple[int, ...], float] = {}
    share = balance
    for _ in range(rounds):
        for p, _c in patterns:
            odds = [1 - share, share]
            for side in (0, 1):
                for j, v in enumerate(p):
                    odds[side] *= rate[side][j][v]
            post[p] = odds[1] / (odds[0] + odds[1])
        share = (sum(c * post[p] for p, c in patterns) + pseudo * balance) / (whole + pseudo)
        for side in (0, 1):
            mass = sum(c * (post[p] if side else 1 - post[p]) for p, c in patterns)
            for j, b in enumerate(beliefs):
                for v in (-1, 0, 1):
                    seen = sum(c * (post[p] if side else 1 - post[p]) for p, c in patterns if p[j] == v)
                    rate[side][j][v] = (seen + pseudo * b[side][v]) / (mass + pseudo)
        for j in one_sided:
            if rate[1][j][-1] > false_alarms:
                rate[1][j] = {-1: false_alarms, 0: 1 - false_alarms, 1: rate[1][j][1]}
    return Estimate(post, share, rate)


def judge(docs: DataFrame, *keys: str, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id and the columns ``keys``, measures, base_failed, quality_probability, kept."""
    rules = votes()
    voted = checkpoint(measures(docs, *keys).withColumns({f"vote_{k}": v for k, v in rules.items()}))
    names = [f"vote_{k}" for k in rules]
    rows = voted.groupBy(*names).count().collect()  # at most 3 to the number of rules
    post = estimate(sorted((tuple(r[n] for n in names), r["count"]) for r in rows)).posterior
    table = voted.sparkSession.createDataFrame([(*p, x) for p, x in post.items()], ", ".join(f"{n} int" for n in names) + ", quality_probability double")
    out = voted.join(F.broadcast(table), names)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= keep_from)).drop(*names)


def keep(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that are kept, with their columns as they came.

    Rows are told apart by doc_id (which may be null or repeated) and text, so that
    each is kept or not by its own text.
    """
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("_key"))
    kept = judge(keyed, "_key", keep_from=keep_from).filter("kept").select(F.col("doc_id").alias("_id"), "_key").distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (text_key(docs["text"]) == kept["_key"]), "left_semi")
