"""Markdown of reports, as a column or from collected rows, and of one benchmark.

Fixed values: headings, labels and table heads below are the format's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.benchmark import Report
from attestra.operators.report import approved
from attestra.schemas import APPROVED


def half_up(x: float) -> int:
    """Rounded to the nearest whole number, halves away from zero."""
    return int(math.floor(abs(x) + 0.5)) * (-1 if x < 0 else 1)


def fixed(x: float, decimals: int) -> str:
    """As printf writes it: the exact binary value, halves to even."""
    return f"{x:.{decimals}f}"


def percent(x: float) -> str:
    return f"{fixed(x * 100, 1)}%"


def proof_report(verdicts: list[dict], title: str = "Claim Report") -> str:
    """verdicts: rows of ``verify.verdicts`` with fingerprint, in order."""
    good = sum(v["status"] in APPROVED for v in verdicts)
    rate = good / len(verdicts) if verdicts else 0.0
    out = [f"# {title}", "", f"**Publish status:** {'PASS' if verdicts and good == len(verdicts) else 'BLOCKED'}", f"**Supported claims:** {half_up(rate * 100)}% ({good}/{len(verdicts)})", ""]
    for v in verdicts:
        out += [f"## [{v['status'].upper()}] {v['text']}", "", f"Type: `{v['type']}` · Fingerprint: `{v['fingerprint']}`", "", v["explanation"]]
        for e in v["evidence"]:
            out += [f"- `{e['id']}` {e['source']} — {half_up(e['score'] * 100)}% term coverage", f"  > {e['text'].replace(chr(10), ' ')}"]
        out.append("")
    return "\n".join(out)


def proof_reports(verdicts: DataFrame, documents: DataFrame, title: str = "Claim Report") -> DataFrame:
    """doc_id, markdown: ``proof_report`` of every document as a column; one shuffle by document."""
    c = F.col
    whole = lambda x: F.floor(x * 100 + 0.5).cast("string")  # noqa: E731  (rates are not negative)
    lines = lambda *xs: F.array_join(F.array(*xs), "\n")
    match = lambda e: lines(F.concat(F.lit("- `"), e["id"], F.lit("` "), e["source"], F.lit(" — "), whole(e["score"]), F.lit("% term coverage")), F.concat(F.lit("  > "), _one_line(e["text"])))
    head = F.concat(F.lit("## ["), F.upper("status"), F.lit("] "), c("text"))
    kind = F.concat(F.lit("Type: `"), c("type"), F.lit("` · Fingerprint: `"), c("fingerprint"), F.lit("`"))
    block = F.array_join(F.concat(F.array(head, F.lit(""), kind, F.lit(""), c("explanation")), F.transform("evidence", match), F.array(F.lit(""))), "\n")
    blocks = verdicts.select("doc_id", F.struct("ordinal", block.alias("block"), approved(c("status")).alias("good")).alias("b")).groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    every = documents.select("doc_id").distinct().join(blocks, "doc_id", "left")
    n, good = F.coalesce(F.size("b"), F.lit(0)), F.coalesce(F.size(F.filter("b", lambda b: b["good"])), F.lit(0))
    n, good = F.greatest(n, F.lit(0)), F.greatest(good, F.lit(0))
    rate = F.when(n > 0, good / n).otherwise(0.0)
    first = lines(
        F.lit(f"# {title}"), F.lit(""), F.concat(F.lit("**Publish status:** "), F.when((n > 0) & (n == good), "PASS").otherwise("BLOCKED")),
        F.concat(F.lit("**Supported claims:** "), whole(rate), F.lit("% ("), good.cast("string"), F.lit("/"), n.cast("string"), F.lit(")")), F.lit(""),
    )
    return every.select("doc_id", F.array_join(F.concat(F.array(first), F.coalesce(F.transform("b", lambda b: b["block"]), F.array().cast("array<string>"))), "\n").alias("markdown"))


def _one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def _table(head: str, rows: list[str], right: int) -> list[str]:
    return [head, "| --- |" + " ---: |" * right, *rows]


def calibration_line(b: dict) -> str:
    return f"| {fixed(b['lower'], 1)}–{fixed(b['upper'], 1)} | {b['n_cases']} | {fixed(b['mean_confidence'], 2)} | {percent(b['exact_rate'])} |"


def benchmark_report(r: Report, title: str = "Benchmark", command: str = "attestra benchmark <corpus> --release") -> str:
    m, x, g, q = r.m, r.extraction, r.gate, r.release
    least = lambda name, value, bound: f"| {name} | {percent(value)} | ≥ {percent(bound)} |"
    most = lambda name, value, bound: f"| {name} | {percent(value)} | ≤ {percent(bound)} |"
    count = lambda name, value, bound, sign="≥": f"| {name} | {value} | {sign} {bound} |"
    head = "| Metric | Result | Required |"
    d = r.metadata
    profile = "Corpus profile: unspecified synthetic/development metadata."
    if d:
        profile = f"Corpus profile: {d['origin']} · {d['split']} · {d['annotatorsPerClaim']} annotator(s)/claim · binary agreement {fixed(d['binaryLabelAgreement'], 2)}."
    out = [f"# {title} {r.version}", "", f"**Safety gate:** {'PASS' if r.passes else 'FAIL'}", f"**Corpus:** {r.name}", ""]
    out += _table(head, [
        least("Verdict accuracy", m["verdict_accuracy"], g.verdict_accuracy), most("False-supported rate", m["false_supported_rate"], g.false_supported_rate), least("Contradiction recall", m["contradiction_recall"], g.contradiction_recall),
        least("Extraction precision", x["precision"], g.extraction_precision), least("Extraction recall", x["recall"], g.extraction_recall),
    ], 2)
    out += ["", f"Cases: {m['n_cases']} verdict · {x['n_cases']} extraction · {m['n_cases'] - m['n_exact']} exact-verdict failures · {m['n_dangerous']} dangerous approvals", ""]
    out += ["## Ship criteria", "", f"**Ship criteria:** {'MET' if r.ships else 'NOT MET'} — necessary on this development corpus, sufficient only on independently labeled realistic documents.", ""]
    out += _table(head, [least("Supported-claim precision", m["supported_precision"], g.supported_precision), least("Unsupported/contradicted recall", m["unsupported_recall"], g.unsupported_recall)], 2)
    out += ["", *_table("| Diagnostic (report-only) | Result |", [
        f"| Warning precision | {percent(m['warning_precision'])} |", f"| Abstention precision | {percent(m['abstention_precision'])} |", f"| Abstention recall | {percent(m['abstention_recall'])} |",
        f"| Expected calibration error | {fixed(r.calibration_error, 3)} |",
    ], 1)]
    out += ["", "## Production release gate", "", f"**Production release gate:** {'NOT READY' if r.release_failures else 'PASS'} — run with `{command}` to enforce this gate.", "", profile, ""]
    out += _table(head, [
        count("Independent legal matters", r.n_matters, q.matters), count("Non-approvable gold claims", m["n_unsafe"], q.unsafe_cases), count("Approval-eligible gold claims", m["n_approval"], q.approval_cases), count("Dangerous approvals", m["n_dangerous"], 0, "≤"),
        most("False-supported one-sided 95% upper bound", m["upper_bound"], q.upper_bound), least("Approval recall", m["approval_recall"], q.approval_recall), least("Contradiction recall", m["contradiction_recall"], q.contradiction_recall),
        least("Extraction recall", x["recall"], q.extraction_recall), least("Warning precision", m["warning_precision"], q.warning_precision),
    ], 2)
    out += ["", f"Required challenge coverage: {q.cases_per_tag}+ cases each for {', '.join(sorted(q.tags))}.", "", "Release blockers:", *([f"- {f}" for f in r.release_failures] or ["- None."])]
    out += ["", "## Per-category outcomes", "", *_table("| Category | Cases | Exact | Dangerous approvals |", [f"| {k} | {c['n_cases']} | {c['n_exact']} ({percent(c['exact_rate'])}) | {c['n_dangerous']} |" for k, c in sorted(r.categories.items())], 3)]
    bins = [calibration_line(b) for b in r.bins if b["n_cases"]]
    out += ["", "## Calibration", "", *_table("| Confidence | Cases | Avg confidence | Exact-match rate |", bins, 3)]
    if r.mismatches:
        out += ["", "## Verdict mismatches", "", *[f"- `{c['id']}` [{c['category']}]: expected `{c['expected']}`, predicted `{c['predicted']}`" for c in r.mismatches]]
    if r.extraction_mismatches:
        out += ["", "## Extraction mismatches", "", *[f"- `{c['id']}`: {c['false_positives']} extra, {c['false_negatives']} missed" for c in r.extraction_mismatches]]
    return "\n".join(out)
