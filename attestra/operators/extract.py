"""Documents to atomic, typed claims with UTF-16 offsets: narrow, native, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.functions.identity import claim_fingerprint

#: Pieces that put the text together again: a run up to its terminators or the end, a run that a newline stops, or one terminator or newline.
TILE = r"[^.!?\n]+(?:[.!?]+|$)|[^.!?\n]+|[.!?\n]"
CONJUNCTION = r"(?iU)\s+(?:and|but)\s+"
#: What a text of four tokens or more starts with; no token is gone through twice.
FOUR_TOKENS = rf"^(?:(?s:[^{X.TOKEN[1:].split(']')[0]}])*+{X.TOKEN}+){{4}}"
#: Characters of a text in which its first claim is looked for at first.
HEAD = 512
# Phrases of boilerplate, and the phrases that type a claim, in order.
BOILERPLATE = ("please note", "this document is not legal advice")
TYPES = (
    ("recommendation", (" recommends ",), ("recommend ",)),
    ("legalConclusion", (" therefore ", " violated "), ()),
    ("legalRule", (" law requires ", " statute ", " rule requires ", " must be filed", " shall be filed"), ()),
    ("calculation", (" calculated ", " equals "), ()),
    ("quotation", ('"',), ()),
)


def claim_type(text: Column) -> Column:
    """The first type one of whose phrases the lower-case text holds or starts with, else factual."""
    low, out = F.lower(text), None
    for name, inside, first in TYPES:
        hit = F.lit(False)
        for p in inside:
            hit = hit | low.contains(p)
        for p in first:
            hit = hit | low.startswith(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("factual")


def material(sentence: Column, low: Column | None = None) -> Column:
    """low: the sentence in lower case, where it is at hand."""
    low = F.lower(sentence) if low is None else low
    out = (sentence != "") & ~sentence.endswith("?") & low.rlike(FOUR_TOKENS)
    for p in BOILERPLATE:
        out = out & ~low.contains(p)
    return out


def clauses(sentence: Column, low: Column | None = None) -> Column:
    """Parts between conjunctions if there are several and each has three words or more, else the sentence."""
    low = F.lower(sentence) if low is None else low

    def whole(parts: Column) -> Column:
        long = F.forall(parts, lambda p: F.size(F.filter(F.split(p, " "), lambda w: w != "")) >= 3)
        return F.when((F.size(parts) > 1) & long, parts).otherwise(F.array(sentence))

    cut = X.once(F.transform(F.filter(F.split(sentence, CONJUNCTION), lambda p: p != ""), X.trimmed), whole)
    return F.when(low.contains("and") | low.contains("but"), cut).otherwise(F.array(sentence))


def running_sums(values: Column) -> Column:
    """For an array of ints the array of its running sums.

    A fold that appends copies its array each time, so the values are summed in blocks
    of about the square root of their number, and then the blocks' totals.
    """

    def folded(xs: Column) -> Column:
        grown = F.aggregate(xs, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x)))
        return F.slice(grown, 2, F.size(xs))

    def blocks(xs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"), F.lit(1))
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / size).cast("int"))
        return F.transform(starts, lambda k: folded(F.slice(xs, k * size + 1, size)))

    def joined(parts: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), folded(F.transform(parts, lambda p: F.coalesce(F.get(p, F.size(p) - 1), F.lit(0)))))
        return X.once(before, lambda b: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda x: x + F.get(b, k)))))

    return X.once(values, lambda xs: X.once(blocks(xs), joined))


def sentences(text: Column) -> Column:
    """array<struct<start_utf16, end_utf16, raw>> of all sentence matches, untrimmed, in order.

    Offsets are the running length of the tiles.  A tile that no terminator ends is a
    sentence only at the end of the text, or before its final line break.
    """
    tiles = F.regexp_extract_all(text, F.lit(TILE), F.lit(0))

    def placed(t: Column) -> Column:
        n = F.size(t)

        def one(tile: Column, i: Column, end: Column) -> Column:
            rest = F.when(i == n - 1, "").when(i >= n - 3, F.concat(F.get(t, i + 1), F.coalesce(F.get(t, i + 2), F.lit("")))).otherwise("more")
            ends = tile.endswith(".") | tile.endswith("!") | tile.endswith("?") | (rest == "") | (rest == "\r\n") | ((rest == "\n") & ~tile.endswith("\r"))
            found = F.struct((end - X.utf16_length(tile)).alias("start_utf16"), end.alias("end_utf16"), tile.alias("raw"))
            return F.when(tile.rlike(r"[^.!?\n]") & ends, found)

        def all_of(ends: Column) -> Column:
            return F.filter(F.transform(t, lambda tile, i: one(tile, i, F.get(ends, i))), lambda x: x.isNotNull())

        return X.once(running_sums(F.transform(t, X.utf16_length)), all_of)

    return X.once(tiles, placed)


def sentence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ordinal, start_utf16, end_utf16, sentence (trimmed)."""
    rows = docs.select("doc_id", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("sentence_ordinal", "s"))
    return rows.select("doc_id", "sentence_ordinal", "s.start_utf16", "s.end_utf16", X.trimmed(F.col("s.raw")).alias("sentence"))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt evenly, whatever files and row groups they came in.

    To extract claims takes some thirty times the work of a shuffle of the same text, so
    that one large row group, or one folder of long documents, is worth dealing out.
    """
    return docs.repartition(F.xxhash64("doc_id", "text"))


def _made(text: Column) -> Column:
    """array<struct<claim_id, text, parent_text, start_utf16, end_utf16>> of a text's claims, in order."""

    def of(s: Column) -> Column:
        def split(sentence: Column) -> Column:
            return X.once(F.lower(sentence), lambda low: of_lowered(sentence, low))

        def of_lowered(sentence: Column, low: Column) -> Column:
            made = F.transform(
                clauses(sentence, low),
                lambda c, k: F.struct(
                    F.concat(F.lit("claim-"), s["start_utf16"].cast("string"), F.lit("-"), k.cast("string")).alias("claim_id"),
                    c.alias("text"),
                    F.when(c != sentence, sentence).alias("parent_text"),
                    s["start_utf16"].alias("start_utf16"),
                    s["end_utf16"].alias("end_utf16"),
                ),
            )
            return F.when(material(sentence, low), made).otherwise(F.array().cast("array<struct<claim_id:string,text:string,parent_text:string,start_utf16:int,end_utf16:int>>"))

        return X.once(X.trimmed(s["raw"]), split)

    return F.flatten(F.transform(sentences(F.coalesce(text, F.lit(""))), of))


def claims(docs: DataFrame, fingerprint: bool = True) -> DataFrame:
    """doc_id, ordinal, claim_id, text, type, parent_text, start_utf16, end_utf16 (, fingerprint), and scope where ``docs`` have it."""
    return _rows(docs, _made(F.col("text")), fingerprint)


def first_claims(docs: DataFrame, fingerprint: bool = True) -> DataFrame:
    """The ``claims`` of ordinal 0.

    A text is cut beyond its first HEAD characters only where these do not hold its first
    claim for certain: what a sentence is depends on what comes before it and, at the very
    end of the text alone, on a line break behind it.
    """
    text = F.coalesce("text", F.lit(""))
    head = F.substring(text, 1, HEAD)
    certain = lambda c: (F.length(text) <= HEAD) | (c["end_utf16"] <= X.utf16_length(head) - 4)
    first = X.once(F.get(_made(head), F.lit(0)), lambda c: F.when(certain(c), c).otherwise(F.get(_made(text), F.lit(0))))
    return _rows(docs, F.filter(F.array(first), lambda c: c.isNotNull()), fingerprint)


def _rows(docs: DataFrame, made: Column, fingerprint: bool) -> DataFrame:
    own = ["scope"] if "scope" in docs.columns else []
    rows = docs.select("doc_id", *own, F.posexplode(made).alias("ordinal", "c"))
    out = rows.select("doc_id", *own, "ordinal", "c.claim_id", "c.text", claim_type(F.col("c.text")).alias("type"), "c.parent_text", "c.start_utf16", "c.end_utf16")
    return out.withColumn("fingerprint", claim_fingerprint(F.col("text"))) if fingerprint else out
