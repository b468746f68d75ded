"""Tokens, stems, lexicons and structured values as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide verdicts.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from",
    "did", "does", "has", "have", "in", "is", "it", "no", "not", "of", "on", "or",
    "that", "the", "this", "to", "was", "were", "will", "with",
)
NEGATIONS = ("not", "no", "never", "without", "cannot")
SPECULATIVE = ("considering", "possible", "possibly", "proposed", "proposal", "planned", "planning", "might", "could", "draft", "expected", "intends")
OPPOSITES = (("grant", "deny"), ("approve", "reject"), ("admit", "deny"), ("before", "after"), ("increase", "decrease"), ("present", "absent"))
IRREGULAR = {"admitted": "admit", "decreased": "decrease", "denied": "deny", "filed": "file", "granted": "grant", "increased": "increase", "received": "receive"}
SUFFIXES = (("ing", 5), ("ed", 4), ("s", 4))
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

TOKEN = r"[\p{IsAlphabetic}\p{N}][\p{IsAlphabetic}\p{N}\p{M}]*"
WORD = r"[\p{IsAlphabetic}][\p{IsAlphabetic}\p{M}]*"
SPACE = r"[\p{Z}\t-\r\x{85}]"


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without Unicode white space and newlines at either end; the pattern is for what plain spaces leave."""
    plain = F.trim(text)
    first, last = F.substring(plain, 1, 1), F.substring(plain, -1, 1)
    return F.when(first.between("!", "~") & last.between("!", "~"), plain).otherwise(F.regexp_replace(plain, rf"^{SPACE}+|{SPACE}+\z", ""))


def blank(text: Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(trimmed(text) == "", F.lit(True))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and numbers, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def spelled(text: Column) -> Column:
    """The lower-case text such that its tokens are the runs of ASCII letters, digits and of whatever is not ASCII: an ASCII text as it is, any other one as its tokens with blanks between them."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(canonical(text))


def letter_tokens(text: Column) -> Column:
    """Lower-case runs of letters; digits separate."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def canonical(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def stemmed(term: Column) -> Column:
    """Irregular forms, else -ing of more than 5 letters, -ed or -s of more than 4; the first rule wins."""
    n, out = F.length(term), None
    for form, stem in IRREGULAR.items():
        out = (F.when(term == form, stem)) if out is None else out.when(term == form, stem)
    for suffix, least in SUFFIXES:
        out = out.when((n > least) & term.endswith(suffix), F.substr(term, F.lit(1), n - len(suffix)))
    return out.otherwise(term)


def significant_terms(text: Column) -> Column:
    """Distinct stems longer than one character that are no stop words; stop words are tested after stemming."""
    return F.array_distinct(F.filter(F.transform(tokens(text), stemmed), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)))


def structured_values(text: Column) -> Column:
    """Distinct tokens with a digit, and month names."""
    return F.array_distinct(F.filter(tokens(text), lambda t: t.rlike(r"\p{N}") | t.isin(*MONTHS)))


def negated(text: Column) -> Column:
    return F.arrays_overlap(letter_tokens(text), strings(NEGATIONS))


def speculative(text: Column) -> Column:
    return F.arrays_overlap(letter_tokens(text), strings(SPECULATIVE))


def opposed(left: Column, right: Column) -> Column:
    """Either side of an opposite pair on different sides of two sets of stems."""
    out = F.lit(False)
    for a, b in OPPOSITES:
        out = out | (F.array_contains(left, a) & F.array_contains(right, b)) | (F.array_contains(left, b) & F.array_contains(right, a))
    return out


def values_conflict(left: Column, right: Column) -> Column:
    """Both sets have values and neither holds the other."""
    return (F.size(left) > 0) & (F.size(right) > 0) & (F.size(F.array_except(left, right)) > 0) & (F.size(F.array_except(right, left)) > 0)


def utf16_length(text: Column) -> Column:
    """Code units; a text with as many characters as bytes is ASCII and need not be encoded."""
    n = F.length(text)
    return F.when(n == F.octet_length(text), n).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """The UTF-16 code units from start up to end, as big-endian bytes."""
    return F.substr(F.encode(text, "UTF-16BE"), start * 2 + 1, (end - start) * 2)


def safe_file_name(text: Column) -> Column:
    out = F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}_-]", "-")
    return F.when(out == "", "reviewer").otherwise(out)
