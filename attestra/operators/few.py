"""The k best passages of each claim where the evidence is small: a column of the claims, without a shuffle.

The postings of at most ``PASSAGES`` passages of at most ``BYTES`` of text are turned into
arrays once, on the driver, and broadcast.  A task cuts an Arrow batch of claims into terms
(``functions.words``) and scores it against all passages: a term in many of them is a row of
weights, any other one a few pairs.  Larger evidence goes through ``topk``; both give the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.functions import words as W

#: Passages, and bytes of their text, that are broadcast at most.
PASSAGES, BYTES = 2048, 2 << 20
#: Scores (claims x passages) that a task holds at a time, and the share of passages from which a term is a row of weights.
SCORES, FREQUENT = 1 << 20, 1 / 16
#: From here on all scores are sorted; up to here the greatest one is taken k times.
FEW = 16


def fits(evidence: DataFrame) -> bool:
    """Whether the passages (columns text and others) are few and short enough to be broadcast."""
    row = evidence.select("text").limit(PASSAGES + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return row[0] <= PASSAGES and row[1] <= BYTES


@dataclass
class Lists:
    """Postings as arrays.  Passages are in the order in which ties go; a term of a scope has its place in ``own`` (number of the scope x terms + number of the term, ascending)."""

    scopes: pa.Array
    classes: pa.Array
    terms: dict[str, int]
    own: np.ndarray
    passages: pa.StructArray
    allowed: np.ndarray  # class x passage
    row: np.ndarray  # of a term in ``dense``, or -1
    dense: np.ndarray
    start: np.ndarray  # of a term's postings in ``passage`` and ``w``
    passage: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Lists:
        """rows: scope, term, evidence_ordinal, id, w, classes; all rows of a passage have the same classes."""
        names, places, ids = (rows.column(c).to_pylist() for c in ("scope", "evidence_ordinal", "id"))
        keys = list(zip(names, ids, places, strict=True))
        order = sorted(set(keys), key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2]))
        number = {x: i for i, x in enumerate(order)}
        scopes = {x: i for i, x in enumerate(dict.fromkeys(names))}
        own = rows.column("classes").to_pylist()
        classes = {c: i for i, c in enumerate(dict.fromkeys(c for x in own for c in x))}
        allowed = np.zeros((len(classes), len(order)), bool)
        terms: dict[str, int] = {}
        scope, t, p = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for i, (k, term, x) in enumerate(zip(keys, rows.column("term").to_pylist(), own, strict=True)):
            scope[i], t[i], p[i] = scopes[k[0]], terms.setdefault(term, len(terms)), number[k]
            for c in x:
                allowed[classes[c], p[i]] = True
        known, t = np.unique(scope * len(terms) + t, return_inverse=True)
        by = np.lexsort((p, t))
        t, p, w = t[by], p[by], rows.column("w").to_numpy()[by].astype(np.int64)
        start = np.searchsorted(t, np.arange(len(known) + 1))
        many = np.flatnonzero(np.diff(start) > max(1, FREQUENT * len(order)))
        row = np.full(len(known), -1)
        row[many] = np.arange(len(many))
        dense = np.zeros((len(many), len(order)), np.int64)
        of_many = row[t] >= 0
        np.add.at(dense, (row[t[of_many]], p[of_many]), w[of_many])
        kinds = [rows.schema.field(c).type for c in ("evidence_ordinal", "id")]
        passages = pa.StructArray.from_arrays([pa.array([x[2] for x in order], kinds[0]), pa.array([x[1] for x in order], kinds[1])], ["evidence_ordinal", "id"])
        text = pa.string()
        return cls(pa.array(list(scopes), text), pa.array(list(classes), text), terms, known, passages, allowed, row, dense, start, p, w)

    def best(self, scope: pa.Array, kind: pa.Array, claim: np.ndarray, term: np.ndarray, sizes: np.ndarray, k: int) -> pa.ListArray:
        """Of each claim its ``k`` passages with the greatest sums, as structs of evidence_ordinal, id, total and share (total by number of terms).

        claim, term: the claims' known terms (numbers of ``terms``), ascending; sizes: how many terms each claim has, known or not.
        """
        n, none = len(scope), -1
        of, kinds = _number(scope, self.scopes), _number(kind, self.classes)
        wanted = of[claim] * len(self.terms) + term
        t = np.minimum(np.searchsorted(self.own, wanted), max(0, len(self.own) - 1))
        held = (of[claim] != none) & (self.own[t] == wanted) if len(self.own) else np.zeros(len(claim), bool)
        claim, t = claim[held], t[held]
        at, where, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, SCORES // max(1, len(self.passages)))
        for lo in range(0, n if len(t) else 0, step):
            hi = min(n, lo + step)
            a, b = np.searchsorted(claim, [lo, hi])
            scores = self._scores(claim[a:b] - lo, t[a:b], hi - lo)
            scores *= np.where(kinds[lo:hi, None] == none, False, self.allowed[kinds[lo:hi]])
            for c, i, total in _greatest(scores, k):
                at.append(c + lo)
                where.append(i)
                totals.append(total)
        at, where, totals = (np.concatenate(x) for x in (at, where, totals))
        order = np.argsort(at, kind="stable")  # within a claim they came best first
        found = self.passages.take(pa.array(where[order]))
        at, totals = at[order], totals[order]
        out = pa.StructArray.from_arrays([*found.flatten(), pa.array(totals), pa.array(totals / sizes[at])], ["evidence_ordinal", "id", "total", "share"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32)), out)

    def _scores(self, claim: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
        """claims x passages: sums of weights; ``claim`` ascending."""
        scores = np.zeros((n, len(self.passages)), np.int64)
        rows = self.row[t]
        c, r = claim[rows >= 0], rows[rows >= 0]
        nth = np.arange(len(c)) - np.searchsorted(c, c)  # which of its claim's frequent terms
        by = np.argsort(nth, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(nth[by])) + 1):
            scores[c[own]] += self.dense[r[own]]
        c, few = claim[rows < 0], t[rows < 0]
        each = self.start[few + 1] - self.start[few]
        i = np.repeat(self.start[few] - np.cumsum(each) + each, each) + np.arange(each.sum())
        np.add.at(scores.reshape(-1), np.repeat(c, each) * scores.shape[1] + self.passage[i], self.w[i])
        return scores


def _number(values: pa.Array, among: pa.Array) -> np.ndarray:
    """The places of values, -1 for those that are not there."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pc.fill_null(pc.index_in(values, value_set=among, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _greatest(scores: np.ndarray, k: int):
    """Rows, columns and values of each row's k greatest positive values, ties by column: (all first ones), (all second ones) and so on."""
    own = np.arange(len(scores))
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k].T if k > FEW else None
    for nth in range(min(k, scores.shape[1])):
        column = scores.argmax(axis=1) if order is None else order[nth]
        value = scores[own, column]
        some = value > 0
        if not some.any():
            return
        yield own[some], column[some], value[some]
        if order is None:
            scores[own, column] = 0


def lookup(postings: DataFrame, k: int, stem: Callable[[str], str | None] | None = None) -> Callable[[Column, Column, Column], Column]:
    """A function of the columns scope, class and text of claims: struct of top (evidence_ordinal, id, total and share of the ``k`` best passages, best first, ties by id and then by place) and terms (those of the claim's that some passage has).

    postings: as in ``topk.best``, of evidence that ``fits``.  stem: a token's term, or
    None for a token that is no term; without it tokens are the terms.  A null text has none.
    """
    place = postings.schema["evidence_ordinal"].dataType.simpleString()
    rows = postings.select(F.col("scope").cast("string").alias("scope"), "term", "evidence_ordinal", "id", F.col("w").cast("long").alias("w"), "classes").na.drop(subset=["scope", "term", "evidence_ordinal"])
    lists = postings.sparkSession.sparkContext.broadcast(Lists.of(rows.toArrow()))

    @F.arrow_udf(f"struct<top:array<struct<evidence_ordinal:{place},id:string,total:bigint,share:double>>,terms:array<string>>")
    def best(scope: pa.Array, kind: pa.Array, said: pa.Array) -> pa.Array:
        known = lists.value
        claim, term, sizes = W.distinct_terms(said, known.terms, stem)
        shown = pa.array(list(known.terms), pa.string()).take(pa.array(term))
        ends = np.concatenate([[0], np.cumsum(np.bincount(claim, minlength=len(said)))]).astype(np.int32)
        return pa.StructArray.from_arrays([known.best(scope, kind, claim, term, sizes, k), pa.ListArray.from_arrays(pa.array(ends), shown)], ["top", "terms"])

    # or the filter that Spark infers from an explode of the result would have all claims scored a second time
    best = best.asNondeterministic()

    def of(scope: Column, kind: Column, text: Column) -> Column:
        return best(scope.cast("string"), kind, X.spelled(text))

    return of
