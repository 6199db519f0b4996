"""Incremental variants of the batch operators (an extension: nothing here has a batch-only counterpart)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_vendors(stream: DataFrame, key: str = "dedup_key", at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first record of each key within the watermark; state is bounded by it."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each window and kind; works on a batch table as well."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(stream: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def append_each(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """foreachBatch with a checkpoint: a batch is written again, under the same number, after a failure."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
