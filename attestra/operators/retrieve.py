"""Evidence retrieval: Okapi BM25 top-k and the first-k passthrough."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.operators import few, topk
from attestra.operators.verify import KEY

#: Bits after the point of a term's weight.
FRACTION = 40


def clamped(k1: float = 1.2, b: float = 0.75) -> tuple[float, float]:
    """k1 at least 0, b within [0, 1]; not a number means the default."""
    return max(0.0, 1.2 if math.isnan(k1) else k1), min(1.0, max(0.0, 0.75 if math.isnan(b) else b))


def bm25(claims: DataFrame, evidence: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """KEY, evidence_ordinal, id, score, rank: the ``limit`` passages with the highest score.

    Source types play no part.  Terms keep stop words.  Terms' weights add up as fixed-
    point numbers of FRACTION bits: the sum does not depend on the order, so ties are
    ties wherever rows lie.  Corpus statistics are computed once per scope.  Frequent
    terms weigh little and bring in candidates only where they can decide (``topk``).
    """
    if limit > 0 and few.fits(evidence):
        best = few.lookup(weights(evidence, k1, b), limit)(F.col("scope"), F.lit(""), F.col("text"))
        found = claims.select(*KEY, best.alias("_m")).select(*KEY, F.posexplode("_m.top").alias("_place", "_m")).select(*KEY, "_m.*", (F.col("_place") + 1).alias("rank"))
    else:
        own = claims.select(*KEY, F.lit("").alias("class"), F.array_distinct(X.tokens(F.col("text"))).alias("terms"))
        found = topk.best(own, KEY, weights(evidence, k1, b), limit)
    return found.select(*KEY, "evidence_ordinal", "id", (F.col("total") / float(1 << FRACTION)).alias("score"), "rank")


def weights(evidence: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """scope, term, evidence_ordinal, id, w: what a term of a passage adds to the score of a claim that has it, as postings of ``topk``."""
    k1, b = clamped(k1, b)
    passages = evidence.select("scope", "evidence_ordinal", "id", X.tokens(F.col("text")).alias("_terms")).withColumn("_length", F.size("_terms"))
    corpus = passages.groupBy("scope").agg(F.count("*").alias("_n"), (F.sum("_length") / F.count("*")).alias("_mean"))
    tf = passages.select("scope", "evidence_ordinal", "id", "_length", F.explode("_terms").alias("term")).groupBy("scope", "evidence_ordinal", "id", "_length", "term").agg(F.count("*").alias("_tf"))
    df = tf.groupBy("scope", "term").agg(F.count("*").alias("_df"))
    idf = F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    norm = k1 * (1 - b + b * F.col("_length") / F.greatest(F.col("_mean"), F.lit(1.0)))
    weight = idf * (F.col("_tf") * (k1 + 1)) / (F.col("_tf") + norm)
    w = F.greatest(F.round(weight * float(1 << FRACTION)).cast("long"), F.lit(1))
    return tf.join(df, ["scope", "term"]).join(corpus, "scope").select("scope", "term", "evidence_ordinal", "id", w.alias("w"), F.array(F.lit("")).alias("classes"))


def passthrough(claims: DataFrame, evidence: DataFrame, limit: int) -> DataFrame:
    """KEY, evidence_ordinal, id, rank: the first passages of the scope, at least one, in their order."""
    return claims.select(*KEY).join(first_passages(evidence.select("scope", "evidence_ordinal", "id"), limit), "scope")


def first_passages(evidence: DataFrame, limit: int) -> DataFrame:
    """``evidence`` with rank: the first ``limit`` passages of each scope, at least one."""
    rank = F.row_number().over(Window.partitionBy("scope").orderBy("evidence_ordinal"))
    return evidence.withColumn("rank", rank).filter(F.col("rank") <= max(1, limit))


#: All claims of a scope have the same candidates: these passages are then the evidence, and no pair need be formed.
passthrough.passages = lambda evidence, limit: first_passages(evidence, limit).drop("rank")
