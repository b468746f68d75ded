"""Verdicts to reports, decisions, counts and governance signals: one aggregate per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.identity import policy_fingerprint, report_fingerprint
from attestra.schemas import APPROVED, STATUSES, Policy


def approved(status: Column) -> Column:
    return status.isin(*APPROVED)


def reports(verdicts: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each doc_id of ``documents``, with or without claims.

    n_claims, n_supported, support_rate (0 without claims), safe_to_publish (never
    without claims), report_fingerprint, disposition, blocking_ids, review_ids (a
    document without claims is allowed) and status_counts.
    """
    # the slim columns only: evidence and texts do not take part in the shuffle
    slim = verdicts.select("doc_id", F.struct("ordinal", "claim_id", "fingerprint", "status").alias("v"))
    return of_lists(listed(slim, documents))


def listed(slim: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id of ``documents``, each once, and v: the structs v of ``slim`` with this doc_id in order, none for a document without."""
    grouped = slim.groupBy("doc_id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    none = F.array().cast(grouped.schema["v"].dataType)
    return documents.select("doc_id").distinct().join(grouped, "doc_id", "left").withColumn("v", F.coalesce("v", none))


def of_lists(out: DataFrame, *kept: str) -> DataFrame:
    """The reports of rows of doc_id and v (structs of claim_id, fingerprint, status and others, in order), with the columns ``kept``."""
    ids = lambda *s: F.transform(F.filter(F.col("v"), lambda x: x["status"].isin(*s)), lambda x: x["claim_id"])
    tally = lambda s: F.struct(F.lit(s).alias("key"), F.size(F.filter(F.col("v"), lambda x: x["status"] == s)).alias("value"))
    counts = F.filter(F.array(*[tally(s) for s in sorted(STATUSES)]), lambda e: e["value"] > 0)
    out = out.withColumns(
        {
            "n_claims": F.size("v"), "n_supported": F.size(F.filter("v", lambda x: approved(x["status"]))), "report_fingerprint": report_fingerprint(F.col("v")),
            "blocking_ids": ids("contradicted", "unsupported"), "review_ids": ids("partiallySupported", "ambiguous", "notVerifiable"), "status_counts": F.map_from_entries(counts),
        }
    )
    return out.select(
        "doc_id", "n_claims", "n_supported",
        F.when(F.col("n_claims") > 0, F.col("n_supported") / F.col("n_claims")).otherwise(0.0).alias("support_rate"),
        ((F.col("n_claims") > 0) & (F.col("n_claims") == F.col("n_supported"))).alias("safe_to_publish"), "report_fingerprint",
        F.when(F.size("blocking_ids") > 0, "block").when(F.size("review_ids") > 0, "requireReview").otherwise("allow").alias("disposition"),
        "blocking_ids", "review_ids", "status_counts", *kept,
    )


def signals(reports: DataFrame, policy: Policy | None = None, trace_id: Column | None = None, run_id: Column | None = None, action_id: Column | None = None) -> DataFrame:
    """Governance signals; ``issue`` is null for a valid one."""
    text = F.lit(None).cast("string")
    out = reports.select(
        "doc_id", F.lit(1).alias("version"), "disposition", F.col("report_fingerprint").alias("reportFingerprint"), F.lit(policy_fingerprint(policy or Policy())).alias("policyFingerprint"),
        F.col("blocking_ids").alias("blockingClaimIDs"), F.col("review_ids").alias("reviewClaimIDs"), F.col("n_supported").alias("supportedClaimCount"), F.col("n_claims").alias("totalClaimCount"),
        (text if trace_id is None else trace_id).alias("traceID"), (text if run_id is None else run_id).alias("runID"), (text if action_id is None else action_id).alias("actionID"),
    )
    return out.withColumn("issue", signal_issue())


def signal_issue() -> Column:
    """The first invariant that a signal's columns break, or null."""
    some = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.coalesce(x == "", F.lit(True)))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    out = F.when(~(F.col("version") >= 1), "version must be positive").when(F.col("version").isNull() | F.col("disposition").isNull(), "a required field is missing")
    for c in ("reportFingerprint", "policyFingerprint"):
        out = out.when(empty(c), f"{c} must be non-empty")
    out = out.when(F.col("supportedClaimCount") < 0, "supportedClaimCount must be non-negative").when(F.col("totalClaimCount") < 0, "totalClaimCount must be non-negative")
    out = out.when(F.col("supportedClaimCount") > F.col("totalClaimCount"), "supportedClaimCount cannot exceed totalClaimCount")
    for c in ("blockingClaimIDs", "reviewClaimIDs"):
        out = out.when(some(c), f"{c} entries must be non-empty")
    for c in ("traceID", "runID", "actionID"):
        out = out.when(F.col(c) == "", f"{c} must be non-empty when present")
    return out


def signal_json(signals: DataFrame) -> DataFrame:
    """doc_id, json: a signal for a bus or webhook; absent ids are left out."""
    names = ["version", "disposition", "reportFingerprint", "policyFingerprint", "blockingClaimIDs", "reviewClaimIDs", "supportedClaimCount", "totalClaimCount", "traceID", "runID", "actionID"]
    return signals.select("doc_id", F.to_json(F.struct(*names)).alias("json"))
