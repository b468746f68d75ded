"""Entities as Spark schemas, their domains, and the policy and gate constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The wire names of every enumeration.
SOURCE_TYPES = ("evidence", "declaration", "courtRecord", "statute", "regulation", "courtRule", "caseLaw", "calculationInput", "unknown")
CLAIM_TYPES = ("factual", "legalRule", "legalConclusion", "calculation", "recommendation", "quotation", "unknown")
STATUSES = ("directlySupported", "supportedByInference", "partiallySupported", "contradicted", "ambiguous", "unsupported", "notVerifiable")
DISPOSITIONS = ("allow", "requireReview", "block")
CATEGORIES = ("directSupport", "reasonableInference", "partialSupport", "contradiction", "unsupported", "notVerifiable", "citationIntegrity", "sourceAuthority")
APPROVED = ("directlySupported", "supportedByInference")
ABSTAINED = ("notVerifiable", "ambiguous")

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PASSAGE = struct(id=_S, source=_S, sourceType=_S, text=_S)
SPAN = struct(evidenceID=_S, exactQuote=_S, startUTF16=_I, endUTF16=_I)
INPUT = struct(document=_S, evidence=T.ArrayType(PASSAGE))
METADATA = struct(origin=_S, split=_S, independentlyLabeled=_B, annotatorsPerClaim=_I, binaryLabelAgreement=_D, annotationPolicyVersion=_S)
CLAIM_CASE = struct(
    id=_S, category=_S, claimText=_S, claimType=_S, evidence=T.ArrayType(PASSAGE), expectedStatus=_S, rationale=_S,
    matterID=_S, challengeTags=T.ArrayType(_S), goldEvidenceSpans=T.ArrayType(SPAN),
)
EXTRACTION_CASE = struct(id=_S, document=_S, expectedClaims=T.ArrayType(_S))
CORPUS = struct(version=_S, name=_S, metadata=METADATA, claimCases=T.ArrayType(CLAIM_CASE), extractionCases=T.ArrayType(EXTRACTION_CASE))
CANDIDATE = struct(id=_S, matterID=_S, claimText=_S, claimType=_S, evidence=T.ArrayType(PASSAGE), challengeTags=T.ArrayType(_S), evidenceSourceRecordIDs=T.MapType(_S, _S))
CANDIDATES = struct(version=_S, name=_S, sourceLedgerVersion=_S, annotationPolicyVersion=_S, candidates=T.ArrayType(CANDIDATE))
SOURCE_RECORD = struct(
    id=_S, matterID=_S, title=_S, canonicalURL=_S, sourceType=_S, jurisdiction=_S, retrievedAt=_S, authorizationBasis=_S, licenseOrTerms=_S,
    redistributionPermitted=_B, contentSHA256=_S, deidentificationReview=_S, containsDirectPersonalIdentifiers=_B, containsRestrictedMaterial=_B,
)
LEDGER = struct(version=_S, sources=T.ArrayType(SOURCE_RECORD))
LABEL = struct(assignmentID=_S, approvalEligible=_B, status=_S, rationale=_S, evidenceSpans=T.ArrayType(SPAN))
SUBMISSION = struct(schemaVersion=_S, corpusVersion=_S, reviewerAlias=_S, annotationPolicyVersion=_S, responses=T.ArrayType(LABEL))
ASSIGNMENT = struct(assignmentID=_S, reviewerAlias=_S, candidateID=_S)
MANIFEST = struct(schemaVersion=_S, candidateCorpus=CANDIDATES, assignments=T.ArrayType(ASSIGNMENT), intakeValidationPassed=_B)
OVERRIDES = struct(supportedThreshold=_D, ambiguousThreshold=_D, contradictionThreshold=_D, maximumEvidenceMatches=_I)
REQUEST = struct(document=_S, evidence=T.ArrayType(PASSAGE), policy=OVERRIDES, includeMarkdown=_B, includeProvenance=_B, runID=_S)


@dataclass(frozen=True)
class Policy:
    """Thresholds of a verification and how many evidence matches a verdict carries."""

    supported: float = 0.80
    ambiguous: float = 0.40
    contradiction: float = 0.55
    maximum_evidence: int = 3

    def __post_init__(self) -> None:
        if self.maximum_evidence < 0:
            raise ValueError(f"maximumEvidenceMatches must be non-negative: {self.maximum_evidence}")


# The numbers of the two gates.
@dataclass(frozen=True)
class Gate:
    """What a benchmark has to reach on a development corpus, and to ship."""

    verdict_accuracy: float = 0.70
    false_supported_rate: float = 0.0
    contradiction_recall: float = 0.80
    extraction_precision: float = 0.80
    extraction_recall: float = 0.80
    supported_precision: float = 0.95
    unsupported_recall: float = 0.90


@dataclass(frozen=True)
class ReleaseGate:
    """What a benchmark has to reach on a sealed realistic corpus."""

    unsafe_cases: int = 300
    approval_cases: int = 100
    upper_bound: float = 0.01
    approval_recall: float = 0.80
    contradiction_recall: float = 0.95
    contradiction_cases: int = 50
    extraction_recall: float = 0.98
    extraction_cases: int = 50
    warning_precision: float = 0.80
    matters: int = 50
    annotators: int = 2
    agreement: float = 0.80
    tags: tuple[str, ...] = ("actor", "amount", "compoundClaim", "date", "modality", "negation", "quotation", "sourceAuthority")
    cases_per_tag: int = 20
