"""Extraction and verification of a stream of documents against static evidence.

Both are stateless per claim, so micro-batches go through the batch operators and the
result of a stream is that of a batch over the same documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.operators import extract, verify
from attestra.schemas import Policy


def claims(documents: DataFrame) -> DataFrame:
    """Claims of a streaming DataFrame of doc_id, text: append mode, no state."""
    return extract.claims(documents)


def verdicts(documents: DataFrame, evidence: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, scope: str = "all", policy: Policy | None = None) -> StreamingQuery:
    """Starts a query that hands each micro-batch's verdicts to ``sink(verdicts, batch_id)``.

    A batch may come again after a failure; a sink that overwrites by batch id makes
    the whole exactly-once.
    """

    def each(batch: DataFrame, number: int) -> None:
        own = extract.claims(batch).withColumn("scope", F.lit(scope))
        sink(verify.verdicts(own, evidence, policy), number)

    return documents.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
