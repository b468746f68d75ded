"""The k best passages of each claim by summed term weights, without scoring all pairs.

The postings of a term are known by the heads of their list (its DEPTH heaviest), by the
heaviest weight beyond the head, and by levels of weight.  A claim goes through two
rounds, both exact in what they leave out:

1. Its heaviest terms offer the heads of their lists; lighter ones, whose weights cannot
   reach the k-th weight of one term all together, do not.  Of these candidates those are
   scored in full whose known weights, with the most that the rest can add, reach the
   k-th known weight.  The k-th score is a floor.
2. A passage that no head has shown weighs at most the next weight in each asked term's
   list and the greatest one in each other term's.  If these do not reach the floor the
   claim is done.  Otherwise its lightest terms, as far as they stay below the floor
   together, are left out, and of each other term only the levels count that a passage at
   the floor must reach in one term at least.  What is found and can still reach the
   floor is scored.

Both rounds are joins.  Where claims meet terms and postings, heavy keys are split
(``skew``); where candidates look up their terms, a term of a passage is one row, and
adaptive execution splits the candidates of a popular passage.  Claims are numbered, so repeated and null keys are claims of
their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.skew import split_join
from attestra.operators.stored import stored

TERM = ["scope", "class", "term"]


def level(w: Column) -> Column:
    """Half powers of two; greater weights have no smaller level."""
    return F.floor(2 * F.log2(w.cast("double"))).cast("int")


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("total"), "id", "evidence_ordinal"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def best(claims: DataFrame, key: list[str], postings: DataFrame, k: int, depth: int | None = None) -> DataFrame:
    """key, evidence_ordinal, id, total (long), rank of the ``k`` passages with the greatest total, ties by id and then by place.

    claims: key (with scope), class, terms (distinct).  postings: scope, term,
    evidence_ordinal, id, w (long, 1 or more) and classes, those classes of claims that
    may use the passage; one row for each term of a passage.
    depth: the length of a head; at least k.
    """
    own = stored(claims.select(F.monotonically_increasing_id().alias("claim"), *key, "class", "terms"))
    rows = stored(postings.select("scope", "term", "evidence_ordinal", "id", "w", "classes"))
    if k < 1:
        none = {"evidence_ordinal": rows.schema["evidence_ordinal"].dataType, "id": "string", "total": "long", "rank": "int"}
        return own.select(*key, *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).limit(0)
    depth = max(k, depth or max(4 * k, 8))
    posted = rows.withColumn("class", F.explode("classes")).drop("classes")

    # the lists, by their heads
    place = F.row_number().over(Window.partitionBy(*TERM).orderBy(F.desc("w"), "id", "evidence_ordinal"))
    head = posted.withColumn("r", place).filter(F.col("r") <= depth + 1).groupBy(*TERM).agg(
        F.max("w").alias("most"), F.max(F.when(F.col("r") == k, F.col("w"))).alias("kth"), F.coalesce(F.max(F.when(F.col("r") == depth + 1, F.col("w"))), F.lit(0)).alias("next"),
        F.collect_list(F.when(F.col("r") <= depth, F.struct("evidence_ordinal", "w"))).alias("head"),
    )
    lists = head.join(posted.groupBy(*TERM).agg(F.count("*").alias("n")), TERM)

    # first round
    asked = split_join(own.select("claim", "scope", "class", F.explode("terms").alias("term")), lists, TERM, "claim")
    by = Window.partitionBy("claim").orderBy(F.desc("most"), "n", "term")
    before = F.coalesce(F.sum(F.size("head")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    light = F.sum("most").over(by.rowsBetween(0, Window.unboundedFollowing)) < F.coalesce(F.max("kth").over(Window.partitionBy("claim")), F.lit(0))
    whole = Window.partitionBy("claim")
    asked = asked.withColumn("offers", (before < 8 * depth) & ~light)
    asked = asked.withColumn("bound", F.when(F.col("offers"), F.col("next")).otherwise(F.col("most"))).withColumn("all", F.sum("bound").over(whole))
    asked = stored(asked.select("claim", *TERM, "n", "most", "bound", "all", F.when(F.col("offers"), F.col("head")).alias("head")))
    offered = asked.select("claim", "scope", "all", F.explode("head").alias("h")).select("claim", "scope", "all", "h.*").repartition("claim")
    offered = offered.groupBy("claim", "scope", "all", "evidence_ordinal").agg(F.sum("w").alias("known"))
    kth = F.max(F.when(F.col("r") == k, F.col("known"))).over(whole)
    offered = offered.withColumn("r", F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("known")))).withColumn("kth", F.coalesce(kth, F.lit(0)))
    first = stored(_best(_scored(offered.filter(F.col("known") + F.col("all") >= F.col("kth")), asked, posted), k).drop("rank"))

    # second round
    floor = first.groupBy("claim").agg(F.when(F.count("*") == k, F.min("total")).otherwise(0).alias("floor"))
    left = asked.drop("head").join(floor, "claim", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    left = left.withColumn("rest", F.sum("bound").over(by.rowsBetween(0, Window.unboundedFollowing))).filter((F.col("all") > 0) & (F.col("all") >= F.col("floor")))
    left = left.withColumns({"out": F.coalesce(F.max(F.when(F.col("rest") < F.col("floor"), F.col("rest"))).over(whole), F.lit(0))}).filter((F.col("rest") >= F.col("floor")) & (F.col("bound") > 0))
    part = (F.col("floor") - F.col("out")) * (F.col("bound") / (F.col("all") - F.col("out")))
    left = left.withColumn("least", F.greatest(F.lit(1), F.floor(part).cast("long") - 1))
    left = left.withColumn("slack", F.col("out") + F.sum(F.col("least") - 1).over(whole))
    left = left.select("claim", *TERM, "least", "bound", "slack", "floor", F.explode(F.sequence(level(F.col("least")), F.greatest(level(F.col("least")), level(F.col("bound"))))).alias("level"))
    met = split_join(stored(left), posted.drop("id").withColumn("level", level(F.col("w"))), [*TERM, "level"], "claim", "evidence_ordinal")
    found = met.filter(F.col("w").between(F.col("least"), F.col("bound"))).groupBy("claim", "scope", "evidence_ordinal").agg(F.sum("w").alias("w"), F.first("slack").alias("slack"), F.first("floor").alias("floor"))
    second = _scored(found.filter(F.col("w") + F.col("slack") >= F.col("floor")).select("claim", "scope", "evidence_ordinal"), asked, posted)
    out = _best(first.unionByName(second).distinct(), k)
    return out.join(own.select("claim", *key), "claim").select(*key, "evidence_ordinal", "id", "total", "rank")


def _scored(pairs: DataFrame, asked: DataFrame, posted: DataFrame) -> DataFrame:
    """claim, evidence_ordinal, id, total of pairs of a claim and a passage of its scope: each of the claim's terms is looked up in the passage."""
    terms = pairs.select("claim", "evidence_ordinal").join(asked.select("claim", *TERM), "claim")
    met = terms.join(posted, [*TERM, "evidence_ordinal"])
    return met.groupBy("claim", "evidence_ordinal", "id").agg(F.sum("w").alias("total"))
