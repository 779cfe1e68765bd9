"""Scoring and encoding of streams.

Matching as an aggregate would need state; the precomputed vector table turns
it into a stream-static join, so no state, watermark or late-data rule is
needed.  Checks, page observations and codes are row-wise and run unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ruleweave.functions import vectors
from ruleweave.operators import history, pages
from ruleweave.operators.scoring import score
from ruleweave.sources.history_store import write_batch


def score_vectors(stream: DataFrame, table: DataFrame, text: str = "features") -> DataFrame:
    """JSON vectors to predictions; refused vectors keep their error and no prediction."""
    return score(vectors.spread_codes(vectors.check_vectors(stream, text)), table)


def observe_pages(stream: DataFrame) -> DataFrame:
    """Raw pages to observations; `routing.route_stream` encodes, scores and stores them."""
    return pages.observe(stream)


def write_history(
    scored: DataFrame, path: str, checkpoint: str, created_at: Column | None = None
) -> StreamingQuery:
    """Write valid scored vectors of a stream as history rows, one folder per batch.

    A batch repeated after a failure replaces its own folder, so rows are never
    written twice.
    """
    moment = F.current_timestamp().cast("timestamp_ntz") if created_at is None else created_at

    def write(batch: DataFrame, batch_id: int) -> None:
        valid = batch.where(F.col("vector_error").isNull())
        write_batch(history.scored_rows(valid, moment), path, batch_id)

    return (
        scored.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
