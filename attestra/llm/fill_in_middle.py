"""Fill-in-middle examples: each text is cut at two of its units and its parts are reordered.

Units are rows.  The matches of the unit pattern are exploded with their places, a window
adds up their lengths, each document's cut requests meet the units they name, and the
offsets found go back to the document, whose text is then sliced.  Before anything is
shuffled the matches are only their lengths, one array a text, and equal rows are one;
units, sums, requests and offsets then stay where the key's hash put them, so that only
the texts move once more, to their offsets.

Defined results: a null text is empty; a null doc_id is hashed as no digits; equal rows
(doc_id and text) give equal results, rows that share a doc_id alone are cut apart;
columns of the input stay, those with the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A line with its newline, or what follows the last one.
LINE = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


def _checked(markers: tuple[str, str, str]) -> None:
    """The first place of a marker in an output is its own only if no marker begins inside or at the end of one."""
    starts = {(a, b, i) for a in markers for b in markers for i in range(len(a)) if (a[i:].startswith(b) or b.startswith(a[i:])) and (a, i) != (b, 0)}
    if starts or not all(markers) or len(set(markers)) < 3:
        raise ValueError(f"markers overlap: {markers}")


def _digest(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)


def _draw(i: int) -> Column:
    """The i-th 8-digit group of the hexadecimal digest, from 1, as a number."""
    return F.conv(F.substring("digest", 8 * i - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 7, unit: str = LINE, fim_percent: int = 100, spm_percent: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    A text that is empty or holds a marker is plain; of the others ``fim_percent`` in a
    hundred are cut, and ``spm_percent`` of these begin with the suffix.
    """
    _checked(markers)
    others = [c for c in docs.columns if c not in ("doc_id", "text", *NEW)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text), 256))
    rows = docs.select(key.alias("key"), "doc_id", "text", F.struct(*others).alias("others") if others else F.lit(None).alias("others"))

    matches = F.transform(F.regexp_extract_all(text, F.lit(unit), F.lit(0)), lambda m: F.length(m))
    units = rows.select("key", matches.alias("lengths")).groupBy("key").agg(F.first("lengths").alias("lengths"))
    running = Window.partitionBy("key").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.select("key", F.posexplode("lengths").alias("ordinal", "chars")).select("key", (F.col("ordinal") + 1).alias("ordinal"), F.sum("chars").over(running).alias("end"))

    n = F.regexp_count(text, F.lit(unit)).cast("long")
    cut = [F.pmod(_draw(i), F.col("n") + 1) for i in (1, 2)]
    asked = rows.select("key", n.alias("n"), _digest(seed).alias("digest")).select("key", "n", F.least(*cut).alias("low"), F.greatest(*cut).alias("high")).dropDuplicates(["key"])

    # one request a document with both ordinals: the join needs no other place than the key's
    named = (F.col("u.key") == F.col("r.key")) & ((F.col("ordinal") == F.col("low")) | (F.col("ordinal") == F.col("high")))
    at = lambda which: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(which), F.col("end"))), F.lit(0)).cast("int").alias(which)
    offsets = asked.alias("r").join(ends.alias("u"), named, "left").groupBy("r.key").agg(F.first("n").alias("n"), at("low"), at("high"))

    marked = F.lit(False)
    for marker in markers:
        marked = marked | F.contains(text, F.lit(marker))
    plain = (text == "") | marked | (_draw(3) % 100 >= fim_percent)
    form = F.when(plain, "plain").when(_draw(4) % 100 < spm_percent, "spm").otherwise("psm")
    met = rows.join(offsets, "key").withColumn("digest", _digest(seed))
    out = met.select("doc_id", "text", "others", "n", form.alias("form"), "low", "high")
    p, s, m = map(F.lit, markers)
    prefix, middle, suffix = F.substr(text, F.lit(1), F.col("low")), F.substr(text, F.col("low") + 1, F.col("high") - F.col("low")), F.substr(text, F.col("high") + 1)
    whole = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    chars = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    kept = [F.col(c) if c in ("doc_id", "text") else F.col("others")[c].alias(c) for c in docs.columns if c not in NEW]
    return out.select(*kept, "n", "form", chars(F.col("low")).alias("prefix_chars"), chars(F.col("high") - F.col("low")).alias("middle_chars"), whole.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text, from an output and its form alone."""
    p, s, m = markers
    parts = lambda first, second: rf"(?s)\A\Q{first}\E(.*?)\Q{second}\E(.*?)\Q{m}\E(.*)\z"
    psm, spm = F.regexp_replace(output, parts(p, s), "$1$3$2"), F.regexp_replace(output, parts(s, p), "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
