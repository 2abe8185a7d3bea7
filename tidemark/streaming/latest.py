"""Streams of change-log rows: the latest state of each key, whatever the order in which versions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.snapshot import newest_of, status_of


def latest_stream(log: DataFrame) -> DataFrame:
    """Running ``(k, seq, op, value, status)`` of a streaming log, for output mode ``update`` or ``complete``.

    The state of a key is its newest version, tombstones included, so a version that arrives late neither wins nor brings a deleted
    key back. It grows with the number of keys; nothing expires, as an old key may always be read.
    """
    return newest_of(log, "k").withColumn("status", status_of(F.col("op")))


def windowed_changes(log: DataFrame, time_col: str, *, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Puts and deletes in windows of event time, late rows up to ``delay`` counted."""
    return (
        log.withWatermark(time_col, delay).groupBy(F.window(time_col, length))
        .agg(F.sum((F.col("op") == 1).cast("long")).alias("puts"), F.sum((F.col("op") == 0).cast("long")).alias("deletes"))
        .select(F.col("window.start").alias("window_start"), "puts", "deletes")
    )


def append_to_store(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a streaming log to a Parquet store, each batch sorted by key and newest version first; exactly once by the file sink."""
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
