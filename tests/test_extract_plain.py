"""The shortcuts of extraction give what the patterns alone give."""

from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.operators import extract

TEXTS = ["", " ", "a b c d", "a b c", "  x ý z 1 ", "\tThe court granted it AND the clerk lost it.\n", "one two three BUT four five six", "sand butter candy brand", "İ ii ́ ée d c", "Ⓐ ⅷ 5 x", "é", "𝒳 a and b c d", "...", "~x!", "\x7fabc\x7f", "x" * 50 + " and y z w and p q r", None]


def test_shortcuts_are_the_patterns(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    t = F.col("text")
    parts = F.transform(F.filter(F.split(t, extract.CONJUNCTION), lambda p: p != ""), lambda p: F.regexp_replace(p, rf"^{X.SPACE}+|{X.SPACE}+\z", ""))
    long = F.forall(parts, lambda p: F.size(F.filter(F.split(p, " "), lambda w: w != "")) >= 3)
    got = df.select(
        (X.trimmed(t).eqNullSafe(F.regexp_replace(t, rf"^{X.SPACE}+|{X.SPACE}+\z", ""))).alias("trim"),
        (F.lower(t).rlike(extract.FOUR_TOKENS).eqNullSafe(F.when(t.isNotNull(), F.size(X.tokens(t)) >= 4))).alias("four"),
        (X.utf16_length(t).eqNullSafe((F.octet_length(F.encode(t, "UTF-16BE")) / 2).cast("int"))).alias("units"),
        (extract.clauses(t).eqNullSafe(F.when((F.size(parts) > 1) & long, parts).otherwise(F.array(t)))).alias("clauses"),
    )
    for text, row in zip(TEXTS, got.collect(), strict=True):
        assert all(row), (text, row)
