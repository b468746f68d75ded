"""Human annotation: intake checks, blinded assignments, audit, adjudication.

Inputs are documents as rows (``sources.elements.Document``): the head of a corpus,
ledger, manifest or submission is one row, its candidates, sources, assignments and
responses are tables, checked by joins.  Issues stay tables in order; what reaches the
driver are heads, counts and a summary row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.operators import ordinals
from attestra.operators.benchmark import utf16_matches
from attestra.operators.report import approved
from attestra.operators.stored import stored
from attestra.sources.elements import Document

#: Cohen's kappa that two primary reviewers have to reach.
KAPPA = 0.80


class WorkflowError(ValueError):
    """Intake, reviewers or submissions that cannot be used; ``issues`` says why, ``table`` has all issues in order where they are many."""

    def __init__(self, kind: str, issues: list[str], table: DataFrame | None = None):
        super().__init__(f"{kind}: {'; '.join(issues)}")
        self.kind, self.issues, self.table = kind, issues, table


#: Issues that an error names; its table has the others.
NAMED = 100


def in_order(issues: DataFrame) -> DataFrame:
    """ordinal, section, place, rule, issue: a place over the whole table for each issue."""
    return ordinals.numbered(issues, "section", "place", "rule", "issue", name="ordinal").select("ordinal", "section", "place", "rule", "issue")


def _refused(kind: str, issues: DataFrame) -> None:
    """Raises if there are issues."""
    table = in_order(issues)
    if first := [r["issue"] for r in table.filter(F.col("ordinal") < NAMED).orderBy("ordinal").collect()]:
        raise WorkflowError(kind, first, table)


def first_values(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_k = 1").drop("_k")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


# The texts of all issues below are the workflow's own.
def _checks(rows: DataFrame, section: int, place: str, rules: list[tuple[Column, Column | str]]) -> DataFrame:
    """section, place, rule, issue: a row for each rule that a row breaks, in the order of the rules."""
    said = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(i).alias("rule"), (F.lit(text) if isinstance(text, str) else text).alias("issue"))) for i, (bad, text) in enumerate(rules)])
    out = rows.select(F.lit(section).alias("section"), F.col(place).alias("place"), F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x"))
    return out.select("section", "place", F.col("x.rule").cast("long").alias("rule"), "x.issue")


def _listed(issues: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def document(rows: DataFrame, *arrays: str) -> Document:
    """A document that is one row with nested arrays, as head and lists."""
    return Document(rows, {a.rpartition(".")[2]: rows.select(F.posexplode(a).alias("place", "x")).select("place", "x.*") for a in arrays})


def intake_issues(corpus: Document, ledger: Document) -> DataFrame:
    """section, place, rule, issue of a candidate corpus and its source ledger; none: it is fit for annotation."""
    sources, own = ledger.lists["sources"], corpus.lists["candidates"]
    twice = F.count("*") - F.count_distinct("id") - F.coalesce(F.max(F.col("id").isNull().cast("int")), F.lit(0))
    head = corpus.head.select("version", F.col("annotationPolicyVersion").alias("policy"), F.col("sourceLedgerVersion").alias("ledgerVersion"))
    both = head.crossJoin(ledger.head.select(F.col("version").alias("of"))).crossJoin(own.agg(F.count("*").alias("n"), twice.alias("twice"))).crossJoin(sources.agg(twice.alias("s_twice"))).withColumn("place", F.lit(0))  # four single rows
    general = _checks(both, 0, "place", [
        (X.blank(F.col("version")), "candidate corpus version is empty"), (X.blank(F.col("policy")), "annotation policy version is empty"),
        (~F.col("ledgerVersion").eqNullSafe(F.col("of")), "candidate corpus sourceLedgerVersion does not match the ledger"), (F.coalesce(F.col("n"), F.lit(0)) < 1, "candidate corpus contains no claims"),
        (F.col("s_twice") > 0, "source ledger contains duplicate source IDs"), (F.col("twice") > 0, "candidate corpus contains duplicate candidate IDs"),
    ])
    c, said = F.col, lambda text: F.concat(F.lit("source "), F.col("id"), F.lit(" " + text))
    of_sources = _checks(sources, 1, "place", [
        (X.blank(c("matterID")), said("has no matterID")), (X.blank(c("title")), said("has no title")), (X.blank(c("jurisdiction")), said("has no jurisdiction")), (X.blank(c("retrievedAt")), said("has no retrieval date")),
        ((c("authorizationBasis") == "publicRecordReusePermitted") & X.blank(c("canonicalURL")), said("has no canonical public-record URL")), (X.blank(c("licenseOrTerms")), said("has no license or terms record")),
        (~c("redistributionPermitted"), said("is not cleared for benchmark redistribution")), (c("containsRestrictedMaterial"), said("contains privileged, sealed, confidential, or restricted material")),
        (c("containsDirectPersonalIdentifiers"), said("still contains direct personal identifiers")), (c("deidentificationReview") == "pending", said("has a pending de-identification review")),
        ((c("authorizationBasis") == "deidentifiedWithAuthorization") & (c("deidentificationReview") != "reviewedBySecondPerson"), said("needs second-person de-identification review")),
        (~c("contentSHA256").rlike(r"\A[0-9A-Fa-f]{64}\z"), said("has an invalid SHA-256 digest")),
    ])
    said = lambda text: F.concat(F.lit("candidate "), F.col("id"), F.lit(" " + text))
    ids = F.transform("evidence", lambda e: e["id"])
    mapped = F.array_sort(F.map_keys("evidenceSourceRecordIDs"))
    of_candidates = _checks(own, 2, "place", [
        (X.blank(c("id")), "a candidate has an empty ID"), (X.blank(c("matterID")), said("has no matterID")), (X.blank(c("claimText")), said("has empty claim text")),
        (F.coalesce(F.size("evidence"), F.lit(0)) < 1, said("has no evidence packet")), (F.size(F.array_distinct(ids)) != F.size(ids), said("contains duplicate evidence IDs")),
        (~F.array_sort(F.array_distinct(ids)).eqNullSafe(mapped), said("does not map every evidence passage to exactly one source record")),
    ])
    known = first_values(sources, "id", "place").select(F.col("id").alias("sourceID"), F.col("matterID").alias("s_matter"), F.col("sourceType").alias("s_type"), F.lit(True).alias("known"))
    e = own.select("place", "id", "matterID", "evidenceSourceRecordIDs", F.posexplode("evidence").alias("at", "e")).withColumn("sourceID", F.try_element_at("evidenceSourceRecordIDs", F.col("e.id"))).filter("sourceID is not null")
    e = e.join(known, "sourceID", "left")
    mention = lambda text, tail="": F.concat(F.lit("candidate "), F.col("id"), F.lit(text), F.col("sourceID"), F.lit(tail))
    kind = F.coalesce("e.sourceType", F.lit("unknown"))
    of_evidence = _checks(e, 2, "place", [
        (c("known").isNull(), mention(" references unknown source ")), (c("known") & ~c("s_matter").eqNullSafe(c("matterID")), mention(" references source ", " from another matter")),
        (c("known") & ~F.coalesce("s_type", F.lit("unknown")).eqNullSafe(kind), F.concat(F.lit("candidate "), c("id"), F.lit(" passage "), c("e.id"), F.lit(" has a source type that disagrees with "), c("sourceID"))),
    ]).withColumn("rule", F.col("rule") + 10)
    return _listed([general, of_sources, of_candidates, of_evidence])


def reviewers(aliases: list[str]) -> list[str]:
    """Three trimmed, distinct, non-empty aliases: two primary reviewers and the adjudicator."""
    out = [a.strip() for a in aliases]
    if len(out) != 3:
        raise WorkflowError("invalidReviewers", ["exactly two primary reviewers and one adjudicator are required"])
    if not all(out) or len(set(out)) != 3:
        raise WorkflowError("invalidReviewers", ["reviewer aliases must be non-empty and unique"])
    return out


def assignments(candidates: DataFrame, aliases: list[str], seed: int | None = None) -> DataFrame:
    """reviewer, reviewer_place, place, id, assignment_id, position (in the reviewer's shuffled packet, from 1).

    With a seed, ids follow from it; without one they are fresh.  The order of a packet is
    that of its ids, which tells nothing of the candidates'.
    """
    own = candidates.select("place", "id")
    r = candidates.sparkSession.createDataFrame(list(enumerate(reviewers(aliases))), "reviewer_place int, reviewer string")
    pairs = own.join(F.broadcast(r))  # three reviewers
    key = F.uuid() if seed is None else F.sha2(F.concat_ws("|", F.lit(str(seed)), "reviewer", "id", "place").cast("binary"), 256)
    pairs = pairs.withColumn("assignment_id", F.concat(F.lit("assignment-"), F.lower(key)))
    # each reviewer has a row for each candidate, so places over all reviewers repeat after as many
    dealt, n = ordinals.numbered(pairs, "reviewer_place", "assignment_id", name="position"), own.count()
    return dealt.withColumn("position", (F.pmod("position", F.lit(max(1, n))) + 1).cast("int"))


def prepare(corpus: Document, ledger: Document, aliases: list[str], seed: int | None = None) -> DataFrame:
    """Assignments with their blinded packet items; raises if the intake has issues."""
    aliases = reviewers(aliases)
    _refused("invalidIntake", intake_issues(corpus, ledger))
    own = corpus.lists["candidates"]
    return assignments(own, aliases, seed).join(own.select("place", "matterID", "claimText", "claimType", "evidence"), "place")


def coordinator(corpus: Document, prepared: DataFrame) -> Document:
    """The manifest of ``coordinator_manifest`` as rows."""
    n = corpus.lists["candidates"].count()
    listed = prepared.select((F.col("reviewer_place") * n + F.col("place")).alias("place"), F.col("assignment_id").alias("assignmentID"), F.col("reviewer").alias("reviewerAlias"), F.col("id").alias("candidateID"))
    head = corpus.head.select(F.lit("1").alias("schemaVersion"), F.struct("version", "name", "sourceLedgerVersion", "annotationPolicyVersion").alias("candidateCorpus"), F.lit(True).alias("intakeValidationPassed"))
    return Document(head, {"candidates": corpus.lists["candidates"], "assignments": listed})


def coordinator_manifest(corpus: Document, prepared: DataFrame) -> DataFrame:
    """The one-row document that ``audit`` and ``finalize`` read: the corpus, who reviews what, and that the intake passed."""
    one = F.struct("reviewer_place", "place", F.struct(F.col("assignment_id").alias("assignmentID"), F.col("reviewer").alias("reviewerAlias"), F.col("id").alias("candidateID")).alias("a"))
    listed = prepared.groupBy().agg(F.array_sort(F.collect_list(one)).alias("x")).select(F.transform("x", lambda r: r["a"]).alias("assignments"))
    fields = [c for c in corpus.lists["candidates"].columns if c != "place"]
    candidates = corpus.lists["candidates"].groupBy().agg(F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("c"))), lambda a, b: (a["place"] - b["place"]).cast("int")).alias("y")).select(F.transform("y", lambda r: r["c"]).alias("candidates"))
    own = corpus.head.select("version", "name", "sourceLedgerVersion", "annotationPolicyVersion").crossJoin(candidates).select(F.struct("version", "name", "sourceLedgerVersion", "annotationPolicyVersion", "candidates").alias("candidateCorpus"))
    return own.crossJoin(listed).select(F.lit("1").alias("schemaVersion"), "candidateCorpus", "assignments", F.lit(True).alias("intakeValidationPassed"))


def submission_forms(corpus: Document, prepared: DataFrame) -> DataFrame:
    """reviewer, json: each reviewer's submission with empty responses in packet order, ready to be filled in."""
    null = F.lit(None).cast("string")
    form = F.struct(F.col("assignment_id").alias("assignmentID"), F.lit(None).cast("boolean").alias("approvalEligible"), null.alias("status"), null.alias("rationale"), F.array().cast("array<string>").alias("evidenceSpans"))
    listed = prepared.groupBy("reviewer").agg(F.array_sort(F.collect_list(F.struct("position", form.alias("f")))).alias("x"))
    both = listed.crossJoin(corpus.head.select("version", "annotationPolicyVersion"))
    whole = F.struct(F.lit("1").alias("schemaVersion"), F.col("version").alias("corpusVersion"), F.col("reviewer").alias("reviewerAlias"), "annotationPolicyVersion", F.transform("x", lambda r: r["f"]).alias("responses"))
    return both.select("reviewer", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def finalized_corpus(head: dict, cases: DataFrame) -> DataFrame:
    """json: the one-row corpus that the benchmark reads, of a head and cases that ``finalize`` made."""
    import json

    spark = cases.sparkSession
    listed = cases.select("place", F.to_json(F.struct(*[c for c in cases.columns if c != "place"])).alias("c")).groupBy().agg(F.array_sort(F.collect_list(F.struct("place", "c"))).alias("x"))
    top = spark.createDataFrame([(json.dumps(head, ensure_ascii=False)[1:-1],)], "head string")
    return top.crossJoin(listed).select(F.concat(F.lit("{"), "head", F.lit(',"claimCases":['), F.array_join(F.transform("x", lambda r: r["c"]), ","), F.lit('],"extractionCases":[]}')).alias("json"))


def packets(prepared: DataFrame) -> DataFrame:
    """What reviewers see, in packet order; no candidate id, tag or source record."""
    return prepared.select("reviewer", "position", F.col("assignment_id").alias("assignmentID"), "matterID", "claimText", "claimType", "evidence")


def templates(prepared: DataFrame) -> DataFrame:
    """A response form for each assignment, with explicit nulls."""
    null = F.lit(None).cast("string")
    form = F.struct(F.col("assignment_id").alias("assignmentID"), F.lit(None).cast("boolean").alias("approvalEligible"), null.alias("status"), null.alias("rationale"), F.array().cast("array<string>").alias("evidenceSpans"))
    return prepared.select("reviewer", "position", F.to_json(form, {"ignoreNullFields": "false"}).alias("json"))


def label_issues(labels: DataFrame) -> DataFrame:
    """section, place, rule, issue of labels: rows with reviewer, place, a label's fields and the candidate's id and evidence."""
    c = F.col
    said = lambda text: F.concat(F.lit("reviewer "), F.col("reviewer"), F.lit(", candidate "), F.col("candidate_id"), F.lit(" " + text))
    yes, spans = approved(c("status")), F.coalesce("evidenceSpans", F.array().cast(labels.schema["evidenceSpans"].dataType))
    whole = _checks(labels, 1, "place", [
        (c("approvalEligible") != yes, said("has an approval/status mismatch")), (X.blank(c("rationale")), said("has no rationale")),
        ((yes | (c("status") == "contradicted")) & (F.size(spans) == 0), said("requires at least one exact evidence span")),
    ])
    s = labels.withColumn("_spans", spans).select("place", "reviewer", "candidate_id", "evidence", F.posexplode("_spans").alias("at", "s"))
    s = s.withColumn("p", F.get(F.filter("evidence", lambda e: e["id"] == F.col("s.evidenceID")), F.lit(0)))
    text, quote, start, end = c("p.text"), c("s.exactQuote"), c("s.startUTF16"), c("s.endUTF16")
    there = c("p").isNotNull()
    each = _checks(s, 1, "place", [
        (~there, F.concat(F.lit("reviewer "), c("reviewer"), F.lit(", candidate "), c("candidate_id"), F.lit(" cites unknown evidence "), c("s.evidenceID"))),
        (there & ((quote == "") | ~text.contains(quote)), said("contains a non-byte-present evidence quote")), (there & (start.isNull() != end.isNull()), said("provides only one UTF-16 span boundary")),
        (there & start.isNotNull() & end.isNotNull() & ~utf16_matches(text, quote, start, end), said("has incorrect UTF-16 evidence boundaries")),
    ]).withColumn("rule", F.col("rule") + 10)
    return _listed([whole, each])


def kappa(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """n, n_agree, kappa of two boolean columns; null without rows, or if chance alone would agree."""
    a, b, n = F.col(first), F.col(second), F.count("*")
    c = pairs.agg(n.alias("n"), F.count_if(a == b).alias("n_agree"), F.count_if(a).alias("na"), F.count_if(b).alias("nb"))
    share = lambda x: F.try_divide(F.col(x), F.col("n"))
    pa, pb = share("na"), share("nb")
    expected = pa * pb + (1 - pa) * (1 - pb)
    value = F.when((F.col("n") > 0) & (expected < 1), F.try_divide(share("n_agree") - expected, 1 - expected))
    return c.select("n", "n_agree", value.alias("kappa"))


def disagreements(first: DataFrame, second: DataFrame) -> DataFrame:
    """candidate_id, both reviewers' approvals and statuses, apart: an inner join of their labels on the candidate."""
    other = second.select("candidate_id", F.col("approvalEligible").alias("other"), F.col("status").alias("other_status"))
    apart = (F.col("status") != F.col("other_status")) | (F.col("approvalEligible") != F.col("other"))
    return first.select("candidate_id", "approvalEligible", "status").join(other, "candidate_id").withColumn("apart", apart)


def adjudicated(pairs: DataFrame, third: DataFrame) -> DataFrame:
    """candidate_id, status, decided_by: the first reviewer's status where both agree, else the adjudicator's."""
    own = third.select("candidate_id", F.col("status").alias("third_status"))
    out = pairs.join(own, "candidate_id", "left").withColumn("decided_by", F.when(F.col("apart"), "adjudicator").otherwise("primary"))
    return out.select("candidate_id", F.when(F.col("apart"), F.col("third_status")).otherwise(F.col("status")).alias("status"), "decided_by")


def _labels(manifest: Document, submission: Document) -> DataFrame:
    """A submission's responses with their assignment and candidate, where there is one."""
    assigned = first_values(manifest.lists["assignments"], "assignmentID", "place").select("assignmentID", F.col("reviewerAlias").alias("assigned_to"), "candidateID")
    own = first_values(manifest.lists["candidates"], "id", "place").select(F.col("id").alias("candidate_id"), F.col("place").alias("candidate_place"), "evidence")
    r = submission.head.select(F.col("reviewerAlias").alias("reviewer")).crossJoin(submission.lists["responses"])  # one row
    return r.join(assigned, "assignmentID", "left").join(own, F.col("candidateID") == F.col("candidate_id"), "left")


def _assigned_labels(manifest: Document, submission: Document) -> DataFrame:
    """Labels of the reviewer's own assignments."""
    return _labels(manifest, submission).filter((F.col("assigned_to") == F.col("reviewer")) & F.col("candidate_id").isNotNull())


def _last_labels(labels: DataFrame) -> DataFrame:
    """One label of each candidate, the last one submitted."""
    last = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("place")))
    return labels.withColumn("_k", last).filter("_k = 1").select("candidate_id", "approvalEligible", "status")


@dataclass(frozen=True)
class Audit:
    """What an audit found: a summary, and tables of disputed candidates, of the adjudicator's assignments of these, and of issues, each in order."""

    summary: dict
    disputed: DataFrame
    sealed: DataFrame
    issues: DataFrame
    n_issues: int

    @property
    def reliable(self) -> bool:
        k = self.summary["binaryLabelAgreement"]
        return not self.n_issues and k is not None and k >= KAPPA

    def document(self) -> dict:
        """The whole audit as one document, for a report that lists every id."""
        listed = lambda df, c: [r[0] for r in df.orderBy("ordinal").select(c).toLocalIterator()]
        return self.summary | {"detailedDisagreementCandidateIDs": listed(self.disputed, "id"), "adjudicationAssignmentIDs": listed(self.sealed, "id"), "issues": listed(self.issues, "issue")}


def audit(manifest: Document, primaries: list[Document]) -> Audit:
    """Counts, disagreements, kappa, the adjudicator with their assignments, and issues."""
    spark = manifest.head.sparkSession
    m = manifest.head.select("candidateCorpus.version", "candidateCorpus.annotationPolicyVersion", "intakeValidationPassed").first()
    assigned, n = manifest.lists["assignments"], manifest.lists["candidates"].count()
    heads = [s.head.select("reviewerAlias", "corpusVersion", "annotationPolicyVersion").first() for s in primaries]
    aliases = [h["reviewerAlias"] for h in heads]
    out = {"corpusVersion": m["version"], "reviewerAliases": aliases, "candidateCount": n, "binaryAgreementCount": 0, "binaryDisagreementCount": 0, "adjudicatorAlias": None, "binaryLabelAgreement": None}
    said: list[tuple[int, str]] = []
    none = spark.createDataFrame([], "ordinal long, id string")
    if len(primaries) != 2:
        return Audit(out, none, none, *_found(spark, [(0, "exactly two primary submissions are required")], []))
    if not m["intakeValidationPassed"]:
        said.append((0, "coordinator manifest was not created from a validated intake"))
    if len(set(aliases)) != 2:
        said.append((0, "primary submissions do not have two distinct reviewer aliases"))
    if duplicates(assigned, "assignmentID").limit(1).count():
        said.append((0, "coordinator manifest contains duplicate assignment IDs"))
    kept, tables = [], []
    for i, (head, submission) in enumerate(zip(heads, primaries, strict=True)):
        section, prefix = 1 + 2 * i, f"submission {head['reviewerAlias']}"
        if head["corpusVersion"] != m["version"]:
            said.append((section, f"{prefix} has the wrong corpus version"))
        if head["annotationPolicyVersion"] != m["annotationPolicyVersion"]:
            said.append((section, f"{prefix} has the wrong annotation policy version"))
        got = submission.lists["responses"].select("assignmentID")
        if duplicates(got, "assignmentID").limit(1).count():
            said.append((section, f"{prefix} contains duplicate assignment IDs"))
        due = assigned.filter(F.col("reviewerAlias") == head["reviewerAlias"]).select("assignmentID").distinct()
        missing, extra = due.join(got, "assignmentID", "left_anti").count(), got.distinct().join(due, "assignmentID", "left_anti").count()
        if missing:
            said.append((section, f"{prefix} is missing {missing} assignments"))
        if extra:
            said.append((section, f"{prefix} contains {extra} unexpected assignments"))
        own = stored(_assigned_labels(manifest, submission))
        tables.append(label_issues(own).withColumn("section", F.lit(section + 1)))
        kept.append(_last_labels(own))
    pairs = stored(disagreements(*kept))
    k = kappa(pairs, "approvalEligible", "other").first()
    apart = pairs.filter("apart").select("candidate_id")
    faulty = said or any(t.limit(1).count() for t in tables)
    value = k["kappa"] if not faulty and k["n"] == n else None
    if not faulty and value is None:
        said.append((9, "Cohen's kappa is undefined because both reviewers used only one binary class"))
    third = [r[0] for r in assigned.filter(~F.col("reviewerAlias").isin(*aliases)).select("reviewerAlias").distinct().limit(2).collect()]
    adjudicator = third[0] if len(third) == 1 else None
    if adjudicator is None:
        said.append((9, "manifest does not identify exactly one distinct adjudicator"))
    sealed = assigned.filter(F.col("reviewerAlias") == adjudicator).join(apart, F.col("candidateID") == F.col("candidate_id"), "left_semi")
    listed = lambda df, c: ordinals.numbered(df.select(F.col(c).alias("id")), "id", name="ordinal")
    out |= {"binaryAgreementCount": k["n_agree"], "binaryDisagreementCount": k["n"] - k["n_agree"], "adjudicatorAlias": adjudicator, "binaryLabelAgreement": value}
    return Audit(out, listed(apart, "candidate_id"), listed(sealed, "assignmentID"), *_found(spark, said, tables))


def _found(spark, said: list[tuple[int, str]], tables: list[DataFrame]) -> tuple[DataFrame, int]:
    """Issues of a whole document and of its labels, in order, and their number."""
    own = spark.createDataFrame([(s, i, 0, text) for i, (s, text) in enumerate(said)], "section int, place int, rule long, issue string")
    issues = in_order(_listed([own, *tables]))
    return issues, issues.count()


def reliable(audited: Audit) -> bool:
    return audited.reliable


def category(status: Column) -> Column:
    # The category of each status.
    of = {"directlySupported": "directSupport", "supportedByInference": "reasonableInference", "partiallySupported": "partialSupport", "contradicted": "contradiction", "ambiguous": "notVerifiable", "notVerifiable": "notVerifiable", "unsupported": "unsupported"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), status)


def finalize(manifest: Document, primaries: list[Document], adjudication: Document, origin: str, split: str) -> tuple[dict, DataFrame]:
    """The corpus' head and its claim cases: agreed labels, and adjudicated ones where reviewers differ."""
    audited = audit(manifest, primaries)
    agreement = audited.summary["binaryLabelAgreement"]
    if audited.n_issues or agreement is None:
        _refused("invalidSubmissions", audited.issues.drop("ordinal"))
    if agreement < KAPPA:
        raise WorkflowError("invalidSubmissions", [f"pre-adjudication Cohen's kappa {agreement} is below 0.80"])
    m = manifest.head.select("candidateCorpus.version", "candidateCorpus.name", "candidateCorpus.annotationPolicyVersion").first()
    a = adjudication.head.select("reviewerAlias", "corpusVersion", "annotationPolicyVersion").first()
    if a["reviewerAlias"] in audited.summary["reviewerAliases"]:
        raise WorkflowError("invalidReviewers", ["adjudicator must be distinct from primary reviewers"])
    if (a["corpusVersion"], a["annotationPolicyVersion"]) != (m["version"], m["annotationPolicyVersion"]):
        raise WorkflowError("invalidSubmissions", ["adjudication submission has the wrong corpus or annotation policy version"])
    pairs = stored(disagreements(*[_last_labels(_assigned_labels(manifest, s)) for s in primaries]))
    disputed = pairs.filter("apart").select(F.col("candidate_id").alias("disputed"))
    labels = _labels(manifest, adjudication)
    fits = (F.col("assigned_to") == F.col("reviewer")) & F.col("candidate_id").isNotNull()
    labels = stored(labels.withColumn("fits", F.coalesce(fits, F.lit(False))).join(disputed, F.col("candidate_id") == F.col("disputed"), "left"))
    good = labels.filter(F.col("fits") & F.col("disputed").isNotNull())
    issues = _listed([
        _checks(labels, 1, "place", [(~F.col("fits"), "adjudication contains an unknown assignment"), (F.col("fits") & F.col("disputed").isNull(), F.concat(F.lit("adjudication includes non-disputed candidate "), "candidate_id"))]),
        label_issues(good),
        duplicates(good, "candidate_id").select(F.lit(2).alias("section"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("rule"), F.concat(F.lit("adjudication contains duplicate response for "), "candidate_id").alias("issue")),
    ])
    missing = disputed.join(good.select(F.col("candidate_id").alias("_have")), F.col("disputed") == F.col("_have"), "left_anti").agg(F.count("*").alias("n")).filter("n > 0")
    _refused("invalidSubmissions", issues.unionByName(missing.select(F.lit(3).alias("section"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("rule"), F.concat(F.lit("adjudication is missing "), F.col("n").cast("string"), F.lit(" disputed candidates")).alias("issue"))))
    fields = ["candidate_id", "status", "rationale", "evidenceSpans"]
    first = [_labels(manifest, s).filter("candidate_id is not null").select(*fields, F.lit(i).alias("turn"), "place") for i, s in enumerate(primaries)]
    agreed = first[0].unionByName(first[1]).withColumn("_k", F.row_number().over(Window.partitionBy("candidate_id").orderBy("turn", "place"))).filter("_k = 1").select(*fields)
    chosen = agreed.join(disputed, F.col("candidate_id") == F.col("disputed"), "left_anti").unionByName(good.select(*fields))
    own = manifest.lists["candidates"]
    spans = F.when(F.size("evidenceSpans") > 0, F.col("evidenceSpans"))
    cases = own.join(chosen, F.col("id") == F.col("candidate_id")).select(
        "place", "id", category(F.col("status")).alias("category"), "claimText", "claimType", "evidence", F.col("status").alias("expectedStatus"), "rationale", "matterID", "challengeTags", spans.alias("goldEvidenceSpans")
    )
    metadata = {"origin": origin, "split": split, "independentlyLabeled": True, "annotatorsPerClaim": 2, "binaryLabelAgreement": agreement, "annotationPolicyVersion": m["annotationPolicyVersion"]}
    return {"version": m["version"], "name": m["name"], "metadata": metadata}, cases
