"""Claims against evidence: overlap scores, ranks, verdicts.

Claims carry ``scope``, ``doc_id``, ``ordinal``, ``text``, ``type``; evidence carries
``scope``, ``evidence_ordinal``, ``id``, ``source``, ``source_type``, ``text``.  A claim
sees the evidence of its scope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.functions.words import significant
from attestra.operators import few, topk
from attestra.schemas import CLAIM_TYPES, SOURCE_TYPES, Policy

KEY = ["scope", "doc_id", "ordinal"]
#: Matches of a claim that are looked up one by one at most.
ATTACHED = 8


@dataclass(frozen=True)
class PolicyColumns:
    """A policy that differs from row to row: columns of the claims; ``most`` is the largest maximum_evidence."""

    supported: Column
    ambiguous: Column
    contradiction: Column
    maximum_evidence: Column
    most: int


# Which kinds of source may support which type of claim (sources of unknown kind always may), and the explanations.
ELIGIBLE = {
    "factual": ("evidence", "declaration", "courtRecord"),
    "legalRule": ("statute", "regulation", "courtRule", "caseLaw"),
    "legalConclusion": ("evidence", "declaration", "courtRecord", "statute", "regulation", "courtRule", "caseLaw"),
    "calculation": ("calculationInput",),
    "quotation": ("evidence", "declaration", "courtRecord", "statute", "regulation", "courtRule", "caseLaw", "calculationInput"),
    "recommendation": (),
    "unknown": (),
}
NOT_VERIFIABLE = ("recommendation", "unknown")
EXPLANATIONS = {
    "type": "This claim type requires a verifier or proof policy that is not configured.",
    "none": "No supplied evidence passage shares the claim's material terms.",
    "speculative": "The passage discusses only a possible or proposed event and does not support the claim that it occurred.",
    "contradicted": "The closest evidence uses the same material terms but reverses the claim's polarity.",
    "supported": "A supplied passage covers the claim's material terms.",
    "partial": "Related evidence exists, but it does not cover enough of the claim to prove it.",
    "weak": "The closest passage does not sufficiently support the claim.",
}


def verifiable(kind: Column) -> Column:
    return ~kind.isin(*NOT_VERIFIABLE)


def eligible(source_type: Column, kind: Column) -> Column:
    out = source_type == "unknown"
    for name, allowed in ELIGIBLE.items():
        if allowed:
            out = out | ((kind == name) & source_type.isin(*allowed))
    return out


def eligibility(spark) -> DataFrame:
    """The 63 rows of (type, source_type, eligible)."""
    rows = [(c, s, s == "unknown" or s in ELIGIBLE[c]) for c in CLAIM_TYPES for s in SOURCE_TYPES]
    return spark.createDataFrame(rows, "type string, source_type string, eligible boolean")


def _claim_terms(claims: DataFrame) -> DataFrame:
    return claims.filter(verifiable(F.col("type"))).select(*KEY, "type", X.significant_terms(F.col("text")).alias("terms"))


def _classes(source_type: Column) -> Column:
    """The claim types that a source type may support."""
    return F.filter(F.array(*[F.when(eligible(source_type, F.lit(c)), F.lit(c)) for c in ELIGIBLE if c not in NOT_VERIFIABLE]), lambda c: c.isNotNull())


def best_matches(claims: DataFrame, evidence: DataFrame, keep: int, candidates: DataFrame | None = None) -> DataFrame:
    """KEY, evidence_ordinal, id, score, rank: the ``keep`` best of the eligible passages that share a term with a claim.

    The score is the share of the claim's terms that the passage has; ties go by id and
    then by place.  ``candidates`` (KEY and evidence_ordinal), if given, are the only
    pairs considered, and each is scored where it stands; without them the pairs come
    from the terms' lists (``topk``), never from claims x passages.
    """
    if candidates is None and keep > 0 and few.fits(evidence):
        found = matched(claims, evidence, keep).select(*KEY, F.posexplode("_m.top").alias("_place", "_of"))
        return found.select(*KEY, "_of.evidence_ordinal", "_of.id", F.col("_of.share").alias("score"), (F.col("_place") + 1).alias("rank"))
    own = _claim_terms(claims)
    if candidates is not None:
        return ranked(_candidate_scores(own, evidence, candidates), keep)
    sized = own.withColumnRenamed("type", "class").withColumn("_size", F.size("terms"))
    found = topk.best(sized, [*KEY, "_size"], _postings(evidence), keep)
    return found.select(*KEY, "evidence_ordinal", "id", (F.col("total") / F.col("_size")).alias("score"), "rank")


def _postings(evidence: DataFrame) -> DataFrame:
    return evidence.select("scope", "evidence_ordinal", "id", _classes(F.col("source_type")).alias("classes"), F.explode(X.significant_terms(F.col("text"))).alias("term"), F.lit(1).cast("long").alias("w"))


def matched(claims: DataFrame, evidence: DataFrame, keep: int) -> DataFrame:
    """``claims`` with _m: top, the ``keep`` best matches (none where not verifiable), and terms, those that passages have, for evidence that ``few.fits``: nothing is joined or shuffled."""
    text = F.when(verifiable(F.col("type")), F.col("text"))
    return claims.withColumn("_m", few.lookup(_postings(evidence), keep, significant)(F.col("scope"), F.col("type"), text))


def _candidate_scores(own: DataFrame, evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """KEY, evidence_ordinal, id, score of the candidate pairs that are eligible and share a term: no pair beside them is formed."""
    passages = evidence.select("scope", "evidence_ordinal", "id", "source_type", X.significant_terms(F.col("text")).alias("_theirs"))
    pairs = candidates.select(*KEY, "evidence_ordinal").distinct().join(own, KEY).join(passages, ["scope", "evidence_ordinal"]).filter(eligible(F.col("source_type"), F.col("type")))
    scored = pairs.select(*KEY, "evidence_ordinal", "id", F.try_divide(F.size(F.array_intersect("terms", "_theirs")), F.size("terms")).alias("score"))
    return scored.filter(F.col("score") > 0)


def ranked(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best matches of each claim: score descending, then id, then place."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "id", "evidence_ordinal"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= keep)


def facts(evidence: DataFrame) -> DataFrame:
    """What the verdict ladder asks of a passage, computed once a passage."""
    t = F.col("text")
    return evidence.select(
        "scope", "evidence_ordinal", F.col("source").alias("p_source"), F.col("source_type").alias("p_source_type"), t.alias("p_text"), X.significant_terms(t).alias("p_terms"),
        X.structured_values(t).alias("p_values"), X.negated(t).alias("p_negated"), X.speculative(t).alias("p_speculative"),
    )


def verdicts(claims: DataFrame, evidence: DataFrame, policy: Policy | PolicyColumns | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """``claims`` with status, confidence, explanation and evidence (array, best first).

    Only the best passage decides.  First of: type not verifiable; nothing in common;
    speculation; reversed polarity or conflicting values; support; partial support;
    else unsupported.
    """
    policy = policy or Policy()
    most = max(1, policy.most if isinstance(policy, PolicyColumns) else policy.maximum_evidence)
    if candidates is None and most <= ATTACHED and few.fits(evidence):
        return judged(matched(claims, evidence, most), evidence, policy)
    top = best_matches(claims, evidence, most, candidates)
    shown = F.struct("rank", "id", F.col("p_source").alias("source"), F.col("p_source_type").alias("source_type"), F.col("p_text").alias("text"), "score", "p_terms")
    first = F.col("rank") == 1
    best = (
        top.join(facts(evidence), ["scope", "evidence_ordinal"])
        .groupBy(*KEY)
        .agg(
            F.max(F.when(first, F.col("score"))).alias("score"),
            F.max_by(F.struct("p_terms", "p_values", "p_negated", "p_speculative"), F.when(first, 1).otherwise(0)).alias("b"),
            F.array_sort(F.collect_list(shown)).alias("shown"),
        )
    )
    out = claims.join(best, KEY, "left").withColumn("_terms", F.when(F.col("score").isNotNull(), X.significant_terms(F.col("text"))))
    return _ladder(out, claims.columns, policy)


def gathered(claims: DataFrame, evidence: DataFrame, policy: Policy | None = None) -> DataFrame:
    """``verdicts`` with all claims of a doc_id in one partition, so that what is grouped by it next is not shuffled again.

    With small evidence the claims and the places of their matches move, once, and the
    passages are looked up behind the shuffle.
    """
    policy = policy or Policy()
    most = max(1, policy.maximum_evidence)
    if most <= ATTACHED and few.fits(evidence):
        top = F.transform("_m.top", lambda m: m.dropFields("total"))
        # terms have no blanks; as one string beside the text they take a fraction of an array
        moved = matched(claims, evidence, most).withColumn("_m", F.struct(top.alias("top"), F.array_join("_m.terms", " ").alias("terms"))).repartition("doc_id")
        terms = F.filter(F.split("_m.terms", " "), lambda t: t != "")
        return judged(moved.withColumn("_m", F.struct("_m.top", terms.alias("terms"))), evidence, policy)
    return verdicts(claims, evidence, policy).repartition("doc_id")


def judged(matches: DataFrame, evidence: DataFrame, policy: Policy | PolicyColumns | None = None) -> DataFrame:
    """The verdicts of ``matched`` claims: what the ladder asks of each match is looked up by its place, so claims stay where they are."""
    policy = policy or Policy()
    most = max(1, policy.most if isinstance(policy, PolicyColumns) else policy.maximum_evidence)
    asked = ["p_source", "p_source_type", "p_text", "p_terms", "p_values", "p_negated", "p_speculative"]
    known = F.broadcast(facts(evidence).dropDuplicates(["scope", "evidence_ordinal"]).select(F.col("scope").alias("_scope"), F.col("evidence_ordinal").alias("_at"), F.struct(*asked).alias("_fact")))
    out, shown = matches, []
    for i in range(most):
        own = known.select("_scope", "_at", F.col("_fact").alias(f"_fact{i}"))
        m, f = F.get(F.col("_m.top"), F.lit(i)), F.col(f"_fact{i}")
        out = out.join(own, (out["scope"] == own["_scope"]) & (m["evidence_ordinal"] == own["_at"]), "left").drop("_scope", "_at")
        shown.append(F.struct(F.lit(i + 1).alias("rank"), m["id"].alias("id"), f["p_source"].alias("source"), f["p_source_type"].alias("source_type"), f["p_text"].alias("text"), m["share"].alias("score"), f["p_terms"].alias("p_terms")))
    out = out.withColumns({"score": F.get(F.col("_m.top"), F.lit(0))["share"], "b": F.col("_fact0"), "shown": F.slice(F.array(*shown), 1, F.size("_m.top")), "_terms": F.col("_m.terms")})
    return _ladder(out, [c for c in matches.columns if c != "_m"], policy)


def _ladder(out: DataFrame, columns: list[str], policy: Policy | PolicyColumns) -> DataFrame:
    """out: claims with _terms (those that passages have, at least), the best match's score and what is known of it (b), and the matches shown, best first."""
    t = F.col("text")
    score, b = F.col("score"), F.col("b")
    # asked of few claims: inside the condition, so that no other claim is cut into words once more
    conflict = X.once(X.structured_values(t), lambda own: X.values_conflict(own, b["p_values"]))
    opposed = X.once(X.significant_terms(t), lambda own: X.opposed(own, b["p_terms"]))
    reversed_ = (X.negated(t) != b["p_negated"]) | opposed | conflict
    rung = (
        F.when(~verifiable(F.col("type")), "type")
        .when(score.isNull(), "none")
        .when((score >= policy.ambiguous) & b["p_speculative"] & ~X.speculative(t), "speculative")
        .when((score >= policy.contradiction) & reversed_, "contradicted")
        .when(score >= policy.supported, "supported")
        .when(score >= policy.ambiguous, "partial")
        .otherwise("weak")
    )
    status = {"type": "notVerifiable", "none": "unsupported", "speculative": "unsupported", "contradicted": "contradicted", "supported": "directlySupported", "partial": "partiallySupported", "weak": "unsupported"}
    pick = lambda of: F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("_rung"))
    confidence = F.when(F.col("_rung").isin("type", "none"), 1.0).when(F.col("_rung") == "weak", 1 - score).otherwise(score)
    kept = F.filter(F.col("shown"), lambda e: e["rank"] <= policy.maximum_evidence)
    listed = F.transform(
        kept,
        lambda e: F.struct(e["id"].alias("id"), e["source"].alias("source"), e["source_type"].alias("source_type"), e["text"].alias("text"), e["score"].alias("score"), F.array_sort(F.array_intersect(F.col("_terms"), e["p_terms"])).alias("matched_terms")),
    )
    none = F.array().cast("array<struct<id:string,source:string,source_type:string,text:string,score:double,matched_terms:array<string>>>")
    return (
        out.withColumn("_rung", rung)
        .withColumns({"status": pick(status), "confidence": F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), "explanation": pick(EXPLANATIONS), "evidence": F.when(F.col("_rung") == "type", none).otherwise(F.coalesce(listed, none))})
        .select(*columns, "status", "confidence", "explanation", "evidence")
    )
