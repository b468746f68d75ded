"""Command line: verify, benchmark, annotate.

Exit codes: 0 passed, 2 not safe to publish, 3 a gate failed, 64 wrong usage, 65 bad
input, 73 output cannot be made.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import render
from attestra.functions.text import safe_file_name
from attestra.operators import annotation, benchmark, extract, provenance, report, verify
from attestra.sources import json as sources


class Usage(Exception):
    pass


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Usage(message)


COMMANDS = ("verify", "benchmark", "annotation", "prepare", "audit", "finalize")


def parser() -> Parser:
    out = Parser(prog="attestra", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True, parser_class=Parser)
    v = sub.add_parser("verify")
    v.add_argument("input")
    v.add_argument("--trace", "--provenance", dest="trace")
    b = sub.add_parser("benchmark")
    b.add_argument("corpus")
    b.add_argument("--json", action="store_true")
    b.add_argument("--release", action="store_true")
    for group in (sub, sub.add_parser("annotation").add_subparsers(dest="command", required=True, parser_class=Parser)):
        _annotation(group)
    return out


def _annotation(sub) -> None:
    """prepare, audit and finalize, with or without the word annotation before them."""
    p = sub.add_parser("prepare")
    p.add_argument("candidates")
    p.add_argument("ledger")
    p.add_argument("out")
    p.add_argument("--reviewers", nargs=3, required=True)
    a = sub.add_parser("audit")
    a.add_argument("manifest")
    a.add_argument("submissions", nargs=2)
    a.add_argument("--json", action="store_true")
    f = sub.add_parser("finalize")
    f.add_argument("manifest")
    f.add_argument("submissions", nargs=3, help="two primary ones, then the adjudicator's")
    f.add_argument("out")
    f.add_argument("--origin", default="publicRecord")
    f.add_argument("--split", default="sealedHoldout")


def run_verify(spark: SparkSession, args: argparse.Namespace) -> int:
    docs, evidence = sources.inputs(spark, args.input)
    verdicts = verify.verdicts(extract.claims(docs).withColumn("scope", F.col("doc_id")), evidence).cache()
    reports = report.reports(verdicts, docs)
    safe = reports.select(F.bool_and("safe_to_publish")).first()[0]
    for row in render.proof_reports(verdicts, docs).orderBy("doc_id").toLocalIterator():
        print(row["markdown"])
    if args.trace:
        events = provenance.events(verdicts, reports)
        _write(provenance.with_ids(events), f"{args.trace}/events")  # ids are fresh: written once, then read
        identified = spark.read.schema(provenance.with_ids(events).schema).json(f"{args.trace}/events")
        edges = provenance.edges(verdicts, reports)
        _write(edges, f"{args.trace}/edges")
        _write_text(provenance.manifests(identified, edges, reports, F.current_timestamp()).select("json"), f"{args.trace}/manifests")
    verdicts.unpersist()
    return 0 if safe else 2


def _write_text(df: DataFrame, path: str) -> None:
    """A text file of each partition, refused where there is one already."""
    try:
        df.write.mode("errorifexists").text(path)
    except Exception as e:
        raise OSError(f"{path}: {e}") from e


def _write(df: DataFrame, path: str) -> None:
    try:
        df.write.mode("errorifexists").json(path)
    except Exception as e:
        raise OSError(f"{path}: {e}") from e


def run_benchmark(spark: SparkSession, args: argparse.Namespace) -> int:
    head, cases, extraction = sources.corpus(spark, args.corpus)
    r = benchmark.run(head["version"], head["name"], head["metadata"], cases, extraction)
    if args.json:
        own = {"version": r.version, "name": r.name, "metrics": r.m, "extraction": r.extraction, "statuses": r.statuses, "categories": r.categories, "calibration": {"bins": r.bins, "error": r.calibration_error}, "confusion": {f"{a}>{b}": n for (a, b), n in r.confusion.items()}, "mismatches": r.mismatches, "releaseFailures": r.release_failures}
        print(json.dumps(own, sort_keys=True, indent=2, ensure_ascii=False))
    else:
        print(render.benchmark_report(r))
    return 0 if (not r.release_failures if args.release else r.passes) else 3


def run_prepare(spark: SparkSession, args: argparse.Namespace) -> int:
    corpus, ledger = sources.candidates(spark, args.candidates), sources.ledger(spark, args.ledger)
    names = spark.createDataFrame([(a.strip(),) for a in args.reviewers], "a string").select(safe_file_name(F.col("a"))).distinct().count()
    if names != 3:
        raise OSError("two reviewers would share a file name")
    if Path(args.out).exists() and any(Path(args.out).iterdir()):
        raise OSError(f"{args.out} is not empty")
    prepared = annotation.prepare(corpus, ledger, args.reviewers)
    _write(prepared, f"{args.out}/assignments")  # ids are fresh: written once, then read
    prepared = spark.read.schema(prepared.schema).json(f"{args.out}/assignments")
    _write(annotation.coordinator_manifest(corpus, prepared).coalesce(1), f"{args.out}/manifest")
    forms = annotation.submission_forms(corpus, prepared)
    for alias in annotation.reviewers(args.reviewers):  # three
        name = spark.range(1).select(safe_file_name(F.lit(alias))).first()[0]
        _write(annotation.packets(prepared).filter(F.col("reviewer") == alias).orderBy("position").coalesce(1), f"{args.out}/packets/{name}")
        _write_text(forms.filter(F.col("reviewer") == alias).select("json").coalesce(1), f"{args.out}/forms/{name}")
    return 0


def run_audit(spark: SparkSession, args: argparse.Namespace) -> int:
    audited = annotation.audit(sources.manifest(spark, args.manifest), [sources.submission(spark, s) for s in args.submissions])
    if args.json:
        print(json.dumps(audited.document(), sort_keys=True, indent=2, ensure_ascii=False))
    else:
        own = audited.summary
        k = own["binaryLabelAgreement"]
        print("\n".join([f"Reviewers: {', '.join(own['reviewerAliases'])}", f"Agreement: {own['binaryAgreementCount']} of {own['candidateCount']}", f"Cohen's kappa: {'undefined' if k is None else render.fixed(k, 3)}", f"Disputed candidates: {audited.disputed.count()}"]))
        for row in audited.issues.orderBy("ordinal").toLocalIterator():
            print(f"Issue: {row['issue']}")
    return 0 if audited.reliable else 3


def run_finalize(spark: SparkSession, args: argparse.Namespace) -> int:
    own = [sources.submission(spark, s) for s in args.submissions]
    head, cases = annotation.finalize(sources.manifest(spark, args.manifest), own[:2], own[2], args.origin, args.split)
    _write_text(annotation.finalized_corpus(head, cases).coalesce(1), args.out)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if len(argv) == 1 and not argv[0].startswith("-") and argv[0] not in COMMANDS:
        argv = ["verify", *argv]  # a path alone is verified
    try:
        args = parser().parse_args(argv)
    except Usage as e:
        print(e, file=sys.stderr)
        return 64
    spark = spark or SparkSession.builder.appName("attestra").getOrCreate()
    try:
        return globals()[f"run_{args.command}"](spark, args)
    except OSError as e:
        print(e, file=sys.stderr)
        return 73
    except Exception as e:  # noqa: BLE001  (unreadable or invalid input)
        print(str(e).splitlines()[0], file=sys.stderr)
        return 65


if __name__ == "__main__":
    sys.exit(main())
