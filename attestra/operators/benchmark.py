"""Benchmark corpora: case results, quality metrics, calibration and gates.

Metrics are aggregates over case results (``id``, ``category``, ``expected``,
``predicted``, ``confidence``); a report joins them on the driver, one row in all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.operators.extract import claims
from attestra.operators.report import approved
from attestra.operators.verify import verdicts
from attestra.schemas import ABSTAINED, CATEGORIES, STATUSES, Gate, Policy, ReleaseGate

Z95 = 1.6448536269514722
BINS = 5


def ratio(n: Column, d: Column) -> Column:
    """n / d; nothing out of nothing is 1."""
    return F.when(d == 0, 1.0).otherwise(n / d)


def upper_bound(events: Column, trials: Column) -> Column:
    """One-sided 95 % upper bound of a rate: exact without events, else Wilson's, at most 1; 1 without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = events / n
    z2 = Z95 * Z95
    wilson = ((p + z2 / (2 * n)) + Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return F.when(trials <= 0, 1.0).when(events == 0, 1 - F.pow(F.lit(0.05), 1 / n)).otherwise(F.least(F.lit(1.0), wilson))


def claim_results(cases: DataFrame, policy: Policy | None = None) -> DataFrame:
    """``cases`` (the claim-case schema) verified, each against its own evidence."""
    own = cases.select(F.col("id").alias("scope"), F.col("id").alias("doc_id"), F.lit(0).alias("ordinal"), F.col("claimText").alias("text"), F.col("claimType").alias("type"), "category", F.col("expectedStatus").alias("expected"))
    e = cases.select(F.col("id").alias("scope"), F.posexplode("evidence").alias("evidence_ordinal", "e"))
    evidence = e.select("scope", "evidence_ordinal", "e.id", "e.source", F.coalesce("e.sourceType", F.lit("unknown")).alias("source_type"), "e.text")
    out = verdicts(own, evidence, policy)
    return out.select(F.col("doc_id").alias("id"), "category", "expected", F.col("status").alias("predicted"), "confidence")


def flags(results: DataFrame) -> DataFrame:
    """Adds passed, dangerous."""
    return results.withColumns({"passed": F.col("predicted") == F.col("expected"), "dangerous": approved(F.col("predicted")) & ~approved(F.col("expected"))})


def extraction_results(cases: DataFrame) -> DataFrame:
    """id, true_positives, false_positives, false_negatives over canonical claim texts."""
    found = claims(cases.select(F.col("id").alias("doc_id"), F.col("document").alias("text")), fingerprint=False)
    predicted = found.groupBy("doc_id").agg(F.collect_set(X.canonical(F.col("text"))).alias("p"))
    out = cases.join(predicted, cases["id"] == predicted["doc_id"], "left")
    p, e = F.coalesce("p", F.array().cast("array<string>")), F.array_distinct(F.transform("expectedClaims", X.canonical))
    return out.select("id", F.size(F.array_intersect(e, p)).alias("true_positives"), F.size(F.array_except(p, e)).alias("false_positives"), F.size(F.array_except(e, p)).alias("false_negatives"))


def precision_recall(extraction: DataFrame) -> DataFrame:
    t, p, n = (F.coalesce(F.sum(c), F.lit(0)) for c in ("true_positives", "false_positives", "false_negatives"))
    return extraction.agg(t.alias("tp"), p.alias("fp"), n.alias("fn"), F.count("*").alias("n_cases")).select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def metrics(results: DataFrame) -> DataFrame:
    """One row of counts and rates over all cases, in one pass."""
    e, p = F.col("expected"), F.col("predicted")
    ea, pa, ex, px = approved(e), approved(p), e.isin(*ABSTAINED), p.isin(*ABSTAINED)
    n = F.count_if
    c = results.agg(
        F.count("*").alias("n_cases"), n(e == p).alias("n_exact"), n(~ea).alias("n_unsafe"), n(ea).alias("n_approval"), n(pa & ~ea).alias("n_dangerous"),
        n(e == "contradicted").alias("n_contradictions"), n((e == "contradicted") & (p == "contradicted")).alias("n_contradictions_found"),
        n(pa).alias("n_approved"), n(pa & ea).alias("n_approved_right"), n(~pa).alias("n_flagged"), n(~pa & ~ea).alias("n_flagged_right"),
        n(px).alias("n_abstained"), n(ex).alias("n_to_abstain"), n(px & ex).alias("n_abstained_right"),
    )
    r = lambda a, b: ratio(F.col(a), F.col(b))
    return c.select(
        "*", r("n_exact", "n_cases").alias("verdict_accuracy"), F.when(F.col("n_unsafe") == 0, 0.0).otherwise(F.col("n_dangerous") / F.col("n_unsafe")).alias("false_supported_rate"),
        upper_bound(F.col("n_dangerous"), F.col("n_unsafe")).alias("upper_bound"), r("n_contradictions_found", "n_contradictions").alias("contradiction_recall"),
        r("n_approved_right", "n_approved").alias("supported_precision"), r("n_approved_right", "n_approval").alias("approval_recall"), r("n_flagged_right", "n_unsafe").alias("unsupported_recall"),
        r("n_flagged_right", "n_flagged").alias("warning_precision"), r("n_abstained_right", "n_abstained").alias("abstention_precision"), r("n_abstained_right", "n_to_abstain").alias("abstention_recall"),
    )


def confusion(results: DataFrame) -> DataFrame:
    return results.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def status_metrics(results: DataFrame) -> DataFrame:
    """All statuses, those without cases too."""
    each = F.explode(F.array(*[F.lit(s) for s in STATUSES]))
    e, p, s = F.col("expected"), F.col("predicted"), F.col("status")
    counted = confusion(results).select(each.alias("status"), "expected", "predicted", "n")
    sums = counted.groupBy("status").agg(F.sum(F.when(e == s, F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(p == s, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when((e == s) & (p == s), F.col("n")).otherwise(0)).alias("m"))
    every = results.sparkSession.range(1).select(each.alias("status"))
    out = every.join(sums, "status", "left").na.fill(0)
    return out.select("status", F.col("e").alias("n_expected"), F.col("p").alias("n_predicted"), F.col("m").alias("n_match"), ratio(F.col("m"), F.col("p")).alias("precision"), ratio(F.col("m"), F.col("e")).alias("recall"))


def category_metrics(results: DataFrame) -> DataFrame:
    """Categories with cases only."""
    c = flags(results).groupBy("category").agg(F.count("*").alias("n_cases"), F.count_if("passed").alias("n_exact"), F.count_if("dangerous").alias("n_dangerous"))
    return c.withColumn("exact_rate", ratio(F.col("n_exact"), F.col("n_cases")))


def calibration(results: DataFrame, bins: int = BINS) -> DataFrame:
    """All bins of confidence: bin, lower, upper, n_cases, mean_confidence, exact_rate."""
    k = F.least(F.greatest((F.col("confidence") * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    g = flags(results).groupBy(k.alias("bin")).agg(F.count("*").alias("n_cases"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("passed").cast("double")).alias("exact_rate"))
    every = results.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(g, "bin", "left").na.fill(0)
    return out.select("bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), "n_cases", "mean_confidence", "exact_rate")


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error: bins by their share of the cases."""
    total = F.sum("n_cases")
    gap = F.sum(F.col("n_cases") * F.abs(F.col("exact_rate") - F.col("mean_confidence")))
    return bins.agg(F.when(total == 0, 0.0).otherwise(gap / total).alias("calibration_error"))


def matters(cases: DataFrame) -> DataFrame:
    m = X.trimmed(F.col("matterID"))
    return cases.agg(F.countDistinct(F.when(m != "", m)).alias("n_matters"), F.count_if(X.blank(F.col("matterID"))).alias("n_without"))


def tag_counts(cases: DataFrame) -> DataFrame:
    return cases.select("id", F.explode(F.array_distinct("challengeTags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def span_valid(span: Column, evidence: Column) -> Column:
    """A quote in the bytes of the first passage with the span's id, at its UTF-16 bounds if both are given; one bound alone is invalid."""
    passage = F.get(F.filter(evidence, lambda e: e["id"] == span["evidenceID"]), F.lit(0))
    text, quote, s, e = passage["text"], span["exactQuote"], span["startUTF16"], span["endUTF16"]
    bounds = F.when(s.isNull() & e.isNull(), True).when(s.isNull() | e.isNull(), False).otherwise(utf16_matches(text, quote, s, e))
    return F.coalesce((quote != "") & text.contains(quote) & bounds, F.lit(False))


def utf16_matches(text: Column, quote: Column, start: Column, end: Column) -> Column:
    inside = (start >= 0) & (end >= start) & (end <= X.utf16_length(text))
    return F.when(inside, X.utf16_slice(text, start, end) == F.encode(quote, "UTF-16BE")).otherwise(False)


def spans_required(cases: DataFrame) -> DataFrame:
    """id, valid of the cases whose expected status needs gold spans."""
    need = cases.filter(approved(F.col("expectedStatus")) | (F.col("expectedStatus") == "contradicted"))
    ok = F.coalesce(F.size("goldEvidenceSpans") > 0, F.lit(False)) & F.coalesce(F.forall("goldEvidenceSpans", lambda s: span_valid(s, F.col("evidence"))), F.lit(False))
    return need.select("id", ok.alias("valid"))


@dataclass
class Report:
    """Everything a rendered benchmark shows; bounded by the cases that fail."""

    version: str
    name: str
    metadata: dict | None
    m: dict
    extraction: dict
    statuses: dict
    categories: dict
    bins: list
    calibration_error: float
    confusion: dict
    n_matters: int
    tags: dict
    mismatches: list
    extraction_mismatches: list
    release_failures: list = field(default_factory=list)
    gate: Gate = field(default_factory=Gate)
    release: ReleaseGate = field(default_factory=ReleaseGate)

    @property
    def passes(self) -> bool:
        m, x, g = self.m, self.extraction, self.gate
        return (
            m["n_unsafe"] > 0 and m["verdict_accuracy"] >= g.verdict_accuracy and m["false_supported_rate"] <= g.false_supported_rate
            and m["contradiction_recall"] >= g.contradiction_recall and x["precision"] >= g.extraction_precision and x["recall"] >= g.extraction_recall
        )

    @property
    def ships(self) -> bool:
        return self.m["n_unsafe"] > 0 and self.m["supported_precision"] >= self.gate.supported_precision and self.m["unsupported_recall"] >= self.gate.unsupported_recall


def release_failures(metadata: dict | None, m: dict, extraction: dict, n_matters: int, n_without_matter: int, tags: dict, n_bad_spans: int, gate: ReleaseGate) -> list[str]:
    """What stands against a release, in the order of the checks."""
    out: list[str] = []

    def unless(ok: bool, said: str) -> None:
        if not ok:
            out.append(said)

    if metadata is None:
        out.append("realistic-corpus metadata is missing")
    else:
        unless(metadata["origin"] != "authoredSynthetic", "corpus origin is authoredSynthetic; a realistic legal corpus is required")
        unless(metadata["split"] == "sealedHoldout", f"corpus split is {metadata['split']}; sealedHoldout is required")
        unless(metadata["independentlyLabeled"], "corpus was not independently labeled")
        unless(metadata["annotatorsPerClaim"] >= gate.annotators, f"annotators per claim {metadata['annotatorsPerClaim']} < {gate.annotators}")
        a = metadata["binaryLabelAgreement"]
        unless(math.isfinite(a) and gate.agreement <= a <= 1, "binary label agreement is outside the accepted range")
        unless(metadata["annotationPolicyVersion"].strip() != "", "annotation policy version is missing")
    unless(n_without_matter == 0, "one or more claim cases have no matterID")
    for count, least, name in ((n_matters, gate.matters, "independent matter count"), (m["n_unsafe"], gate.unsafe_cases, "non-approvable claim count"), (m["n_approval"], gate.approval_cases, "approval-eligible claim count")):
        unless(count >= least, f"{name} {count} < {least}")
    unless(m["n_dangerous"] == 0, f"dangerous approval count {m['n_dangerous']} != 0")
    unless(m["upper_bound"] <= gate.upper_bound, "false-supported 95% upper bound exceeds the required maximum")
    unless(m["approval_recall"] >= gate.approval_recall, "approval recall is below the required minimum")
    unless(m["n_contradictions"] >= gate.contradiction_cases, f"contradiction case count {m['n_contradictions']} < {gate.contradiction_cases}")
    unless(m["contradiction_recall"] >= gate.contradiction_recall, "contradiction recall is below the required minimum")
    unless(extraction["n_cases"] >= gate.extraction_cases, f"extraction case count {extraction['n_cases']} < {gate.extraction_cases}")
    unless(extraction["recall"] >= gate.extraction_recall, "extraction recall is below the required minimum")
    unless(m["warning_precision"] >= gate.warning_precision, "warning precision is below the required minimum")
    for tag in sorted(gate.tags):
        unless(tags.get(tag, 0) >= gate.cases_per_tag, f"challenge tag {tag} count {tags.get(tag, 0)} < {gate.cases_per_tag}")
    unless(n_bad_spans == 0, f"{n_bad_spans} approval-eligible/contradicted cases lack valid exact gold evidence spans")
    return out


def run(version: str, name: str, metadata: dict | None, cases: DataFrame, extraction_cases: DataFrame, policy: Policy | None = None, gate: Gate | None = None, release: ReleaseGate | None = None) -> Report:
    """A corpus' report: distributed aggregates, of which only summary rows and mismatches reach the driver."""
    gate, release = gate or Gate(), release or ReleaseGate()
    results = claim_results(cases, policy).cache()
    extraction = extraction_results(extraction_cases).cache()
    m, x = metrics(results).first().asDict(), precision_recall(extraction).first().asDict()
    own, tags = matters(cases).first(), dict(tag_counts(cases).collect())
    bad_spans = spans_required(cases).filter("not valid").count()
    bins = calibration(results).orderBy("bin")
    at = F.col("place") if "place" in cases.columns else F.monotonically_increasing_id()  # rows read by many tasks come in any order
    order = cases.select("id", at.alias("_at"))
    wrong = flags(results).filter("not passed").join(order, "id").orderBy("_at").collect()
    off = extraction.filter("false_positives + false_negatives > 0").orderBy("id").collect()
    out = Report(
        version, name, metadata, m, x, {r["status"]: r.asDict() for r in status_metrics(results).collect()}, {r["category"]: r.asDict() for r in category_metrics(results).collect()},
        [r.asDict() for r in bins.collect()], calibration_error(bins).first()[0], {(r[0], r[1]): r[2] for r in confusion(results).collect()}, own["n_matters"], tags, [r.asDict() for r in wrong], [r.asDict() for r in off],
        release_failures(metadata, m, x, own["n_matters"], own["n_without"], tags, bad_spans, release), gate, release,
    )
    results.unpersist()
    extraction.unpersist()
    return out


__all__ = ["CATEGORIES", "Report", "run"]
