"""Batch operators on streams: each micro-batch goes through an operator and is merged into a keyed table.

The studied scripts have no streaming of their own; this is what lets the operators run on arriving files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vote_stream(evidence: DataFrame, entity: str, label: str, time: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Votes by (window, entity, label) of a stream, with late data up to delay; a consensus reads the sink's rows."""
    return evidence.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), entity, label).agg(F.count(F.lit(1)).alias("votes"))


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that writes operator(batch) under path, one folder a batch, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
