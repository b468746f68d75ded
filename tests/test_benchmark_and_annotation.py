"""Benchmark metrics, gates, rendering; the annotation workflow."""

import json

import pytest
from pyspark.sql import functions as F

from attestra import render
from attestra import schemas as S
from attestra.operators import annotation as A
from attestra.operators import benchmark as B
from attestra.schemas import CATEGORIES

TEXT = "The court granted the motion."


def results(spark, *rows):
    return spark.createDataFrame([(str(i), "unsupported", *r) for i, r in enumerate(rows)], "id string, category string, expected string, predicted string, confidence double")


def test_empty_ratios_and_bounds(spark):
    m = B.metrics(results(spark).limit(0)).first()
    assert (m["verdict_accuracy"], m["false_supported_rate"], m["upper_bound"]) == (1.0, 0.0, 1.0)
    safe = B.metrics(results(spark, *[("unsupported", "unsupported", 1.0)] * 24)).first()
    assert safe["upper_bound"] == pytest.approx(1 - 0.05 ** (1 / 24))
    wrong = B.metrics(results(spark, ("unsupported", "directlySupported", 1.0), ("unsupported", "unsupported", 1.0))).first()
    assert wrong["n_dangerous"] == 1 and 0.5 < wrong["upper_bound"] <= 1


def test_calibration_has_all_bins(spark):
    bins = B.calibration(results(spark, ("unsupported", "unsupported", 1.0), ("unsupported", "contradicted", 0.2)))
    assert [(r["bin"], r["n_cases"]) for r in bins.orderBy("bin").collect()] == [(0, 0), (1, 1), (2, 0), (3, 0), (4, 1)]
    assert B.calibration_error(bins).first()[0] == pytest.approx(0.1)
    assert B.status_metrics(results(spark).limit(0)).count() == 7


def cases(spark, tag=None, quote="court"):
    evidence = [("p", "src", "courtRecord", TEXT)]
    rows = [
        ("a", "directSupport", TEXT, "factual", evidence, "directlySupported", "r", "m1", [tag or "date", tag or "date"], [("p", quote, None, None)]),
        ("b", "unsupported", "The tenant paid rent in June.", "factual", evidence, "unsupported", "r", "m2", None, None),
    ]
    return spark.createDataFrame(rows, S.CLAIM_CASE)


def test_run_and_render(spark):
    extraction = spark.createDataFrame([("x", f"Hello. {TEXT}", [TEXT.upper()]), ("y", "Short one.", ["a missing claim here now"])], S.EXTRACTION_CASE)
    r = B.run("v0", "Demo", None, cases(spark), extraction)
    assert (r.extraction["tp"], r.extraction["fp"], r.extraction["fn"]) == (1, 0, 1) and r.tags == {"date": 1} and r.n_matters == 2
    assert not r.passes and r.ships and r.release_failures[0] == "realistic-corpus metadata is missing"
    assert not any("gold evidence" in f for f in r.release_failures)
    text = render.benchmark_report(r)
    assert "| Extraction recall | 50.0% | ≥ 80.0% |" in text and "- `y`: 0 extra, 1 missed" in text
    assert B.spans_required(cases(spark, quote="COURT")).first()["valid"] is False


@pytest.mark.parametrize("x, d, want", [(0.25, 1, "0.2"), (1.005, 2, "1.00"), (0.025, 2, "0.03"), (0.5, 0, "0"), (1.5, 0, "2")])
def test_fixed_is_printf(x, d, want):
    assert render.fixed(x, d) == want


def test_report_markdown():
    v = {"status": "directlySupported", "text": TEXT, "type": "factual", "fingerprint": "f", "explanation": "x", "evidence": [{"id": "p", "source": "s", "score": 0.995, "text": "a\nb"}]}
    text = render.proof_report([v])
    assert "**Publish status:** PASS" in text and "100% term coverage" in text and "> a b" in text
    assert "BLOCKED" in render.proof_report([])


# --- annotation


def source(name, **over):
    own = dict(id=name, matterID="m", title="t", canonicalURL="u", sourceType="courtRecord", jurisdiction="j", retrievedAt="d", authorizationBasis="publicRecordReusePermitted", licenseOrTerms="l",
               redistributionPermitted=True, contentSHA256="a" * 64, deidentificationReview="notRequired", containsDirectPersonalIdentifiers=False, containsRestrictedMaterial=False)
    return tuple((own | over)[f.name] for f in S.SOURCE_RECORD)


def corpus_and_ledger(spark, n=5, **over):
    rows = [(f"c{i}", "m", TEXT, "factual", [("p", "src", "courtRecord", TEXT + " Caf\u00e9.")], [], {"p": "s"}) for i in range(n)]
    corpus = spark.createDataFrame([("1", "n", "L", "P", rows)], S.CANDIDATES)
    return A.document(corpus, "candidates"), A.document(spark.createDataFrame([("L", [source("s", **over)])], S.LEDGER), "sources")


def test_intake(spark):
    assert A.intake_issues(*corpus_and_ledger(spark)).count() == 0
    issues = [r["issue"] for r in A.intake_issues(*corpus_and_ledger(spark, 1, title=" ", contentSHA256="zz", sourceType="statute", matterID="other")).orderBy("section", "place", "rule").collect()]
    assert issues == [
        "source s has no title", "source s has an invalid SHA-256 digest", "candidate c0 references source s from another matter", "candidate c0 passage p has a source type that disagrees with s",
    ]


def test_reviewers_and_assignments(spark):
    for bad in (["a", "b"], ["a", "a ", "b"], ["a", " ", "b"]):
        with pytest.raises(A.WorkflowError):
            A.reviewers(bad)
    corpus, ledger = corpus_and_ledger(spark)
    prepared = A.prepare(corpus, ledger, ["x", "y", "z"], seed=1)
    assert prepared.count() == 15 and prepared.select("assignment_id").distinct().count() == 15
    assert "id" not in A.packets(prepared).columns
    form = json.loads(A.templates(prepared).first()["json"])
    assert form["status"] is None and form["approvalEligible"] is None
    with pytest.raises(A.WorkflowError):
        A.prepare(*corpus_and_ledger(spark, 1, title=""), ["x", "y", "z"])


def workflow(spark, second=None, quote=TEXT):
    corpus, ledger = corpus_and_ledger(spark)
    prepared = A.prepare(corpus, ledger, ["x", "y", "z"], seed=1).collect()
    at = {(r["reviewer"], r["id"]): r["assignment_id"] for r in prepared}
    manifest = spark.createDataFrame([("1", corpus.head.first(), [(v, k[0], k[1]) for k, v in at.items()], True)], S.MANIFEST)
    manifest = A.document(manifest, "candidateCorpus.candidates", "assignments")
    base = ["directlySupported", "unsupported", "directlySupported", "unsupported", "contradicted"]

    def submission(who, statuses, more=None):
        rows = [(at[who, f"c{i}"], s == "directlySupported", s, "because", [("p", quote, None, None)] if s != "unsupported" else []) for i, s in statuses]
        return A.document(spark.createDataFrame([("1", "1", who, "P", rows + (more or []))], S.SUBMISSION), "responses")

    both = [submission("x", list(enumerate(base))), submission("y", list(enumerate(second or base[:4] + ["unsupported"])))]
    return manifest, both, submission


def test_audit_and_finalize(spark):
    manifest, both, submission = workflow(spark)
    whole = A.audit(manifest, both)
    audited = whole.document()
    assert audited["issues"] == [] and audited["binaryLabelAgreement"] == 1.0 and audited["detailedDisagreementCandidateIDs"] == ["c4"] and audited["adjudicatorAlias"] == "z" and len(audited["adjudicationAssignmentIDs"]) == 1
    assert A.reliable(whole) and whole.n_issues == 0
    head, rows = A.finalize(manifest, both, submission("z", [(4, "partiallySupported")]), "publicRecord", "sealedHoldout")
    assert {r["id"]: r["expectedStatus"] for r in rows.collect()}["c4"] == "partiallySupported" and head["metadata"]["annotatorsPerClaim"] == 2
    for wrong in ([], [(0, "unsupported"), (4, "unsupported")]):
        with pytest.raises(A.WorkflowError):
            A.finalize(manifest, both, submission("z", wrong), "publicRecord", "sealedHoldout")


def test_audit_finds_bad_labels(spark):
    manifest, both, _ = workflow(spark, quote="Cafe\u0301")  # the accent apart: other bytes
    issues = A.audit(manifest, both).document()["issues"]
    assert issues and all("non-byte-present" in i for i in issues)
    assert A.audit(manifest, both[:1]).document()["issues"] == ["exactly two primary submissions are required"]
    manifest, both, _ = workflow(spark, second=["unsupported"] * 5)
    assert A.audit(manifest, both).summary["binaryLabelAgreement"] == 0.0 and set(CATEGORIES)


def test_assignments_missing_unknown_and_answered_twice(spark):
    """Expected against submitted assignments, the last of several labels, missing adjudications; all issues in order, as a table."""
    manifest, both, submission = workflow(spark)
    first = {r["candidateID"]: r["assignmentID"] for r in manifest.lists["assignments"].filter("reviewerAlias = 'x'").collect()}
    odd = submission("x", [(0, "directlySupported"), (2, "directlySupported"), (4, "contradicted")], [("assignment-none", True, "directlySupported", "because", [("p", TEXT, None, None)]), (first["c0"], False, "unsupported", " ", [])])
    audited = A.audit(manifest, [odd, both[1]])
    want = ["submission x contains duplicate assignment IDs", "submission x is missing 2 assignments", "submission x contains 1 unexpected assignments", "reviewer x, candidate c0 has no rationale"]
    assert [r["issue"] for r in audited.issues.orderBy("ordinal").collect()] == want and audited.n_issues == 4 and not audited.reliable
    assert [r["id"] for r in audited.disputed.orderBy("ordinal").collect()] == ["c0", "c4"]  # the last label of c0 differs from the other reviewer's
    with pytest.raises(A.WorkflowError) as refused:
        A.finalize(manifest, [odd, both[1]], submission("z", []), "publicRecord", "sealedHoldout")
    assert refused.value.issues == want and refused.value.table.count() == 4
    with pytest.raises(A.WorkflowError, match="adjudication is missing 1 disputed candidates"):
        A.finalize(manifest, both, submission("z", []), "publicRecord", "sealedHoldout")


def test_kappa(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "a boolean, b boolean")
    assert A.kappa(df, "a", "b").first()["kappa"] == pytest.approx(0.5)
    assert A.kappa(df.filter("a"), "a", "a").first()["kappa"] is None and A.kappa(df.limit(0), "a", "b").first()["kappa"] is None


def test_categories_and_first_values(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "k string, at int, v string")
    assert A.first_values(df, "k", "at").first()["v"] == "a"
    assert df.select(A.category(F.lit("ambiguous"))).first()[0] == "notVerifiable"


def test_annotation_round_trip_through_files(spark, tmp_path, capsys):
    """prepare -> the reviewers' forms -> audit -> adjudication -> finalize -> benchmark, each from the files of the one before."""
    from attestra import cli

    corpus, ledger = corpus_and_ledger(spark, 40)
    for name, df in (("corpus", corpus), ("ledger", ledger)):
        (tmp_path / f"{name}.json").write_text(df.head.toJSON().first())
    run = tmp_path / "run"
    where = [str(tmp_path / "corpus.json"), str(tmp_path / "ledger.json"), str(run)]
    assert cli.main(["annotation", "prepare", *where, "--reviewers", "x 1", "y", "z"], spark) == 0
    assert cli.main(["prepare", *where, "--reviewers", "x", "y", "z"], spark) == 73 and cli.main(["prepare", where[0], where[1], str(tmp_path / "q"), "--reviewers", "a b", "a-b", "c"], spark) == 73
    one = lambda path: next(p for p in path.iterdir() if p.name.startswith("part-"))
    of = {a["assignmentID"]: a["candidateID"] for a in json.loads(one(run / "manifest").read_text())["assignments"]}
    assert len(of) == 120 and [len(one(run / "packets" / n).read_text().splitlines()) for n in ("x-1", "y", "z")] == [40] * 3

    def filled(name, decide, only=None):
        form = json.loads(one(run / "forms" / name).read_text())
        assert len(form["responses"]) == 40 and all(r["status"] is None for r in form["responses"])
        form["responses"] = [r for r in form["responses"] if only is None or of[r["assignmentID"]] in only]
        for r in form["responses"]:
            status = decide(int(of[r["assignmentID"]][1:]))
            r |= {"status": status, "approvalEligible": status == "directlySupported", "rationale": "because", "evidenceSpans": [] if status == "unsupported" else [{"evidenceID": "p", "exactQuote": TEXT}]}
        (tmp_path / f"{name}.json").write_text(json.dumps(form))
        return str(tmp_path / f"{name}.json")

    base = lambda i: "directlySupported" if i % 2 else "unsupported"
    first, second = filled("x-1", base), filled("y", lambda i: "contradicted" if i == 0 else base(i))
    assert cli.main(["audit", str(run / "manifest"), first, second], spark) == 0
    assert "Cohen's kappa: 1.000" in capsys.readouterr().out
    third = filled("z", lambda i: "partiallySupported", {"c0"})
    out = tmp_path / "final"
    assert cli.main(["finalize", str(run / "manifest"), first, second, third, str(out)], spark) == 0 and cli.main(["finalize", str(run / "manifest"), first, second, third, str(out)], spark) == 73
    assert cli.main(["benchmark", str(out), "--json"], spark) == 3
    got = json.loads(capsys.readouterr().out)
    assert got["metrics"]["n_cases"] == 40 and got["confusion"]["partiallySupported>directlySupported"] == 1 and got["confusion"]["directlySupported>directlySupported"] == 20
