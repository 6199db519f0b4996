"""A stream that learns what to leave out: URLs judged bad in one batch block their kind in the next.

Every batch reads the patterns that the batches before it have added, so it says the same when it is run again
after a failure; what it adds and what it keeps goes to folders named by its number, which a second run replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import sinks
from ..operators import links


def patterns(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The distinct patterns (pattern) below path, of the batches before a number or of all; `seed` is batch -1."""
    rows = spark.read.schema("pattern string, batch int").parquet(path)
    return (rows if before is None else rows.filter(F.col("batch") < before)).select("pattern").distinct()


def seeded(seed: DataFrame, path: str) -> None:
    """Begin a list of patterns (pattern)."""
    seed.select(F.lower("pattern").alias("pattern")).filter("pattern <> ''").distinct().write.mode("overwrite").parquet(f"{path}/batch=-1")


def learning(stream: DataFrame, junk: Column, path: str, kept: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rows of the stream (url and more) that no pattern blocks go to `kept`, in batch=N folders.

    junk: whether a row that was let through turned out to be junk; such rows are not kept, and the first segment of their
    path becomes a pattern if it carries a junk signal. The list of patterns at `path` must have been seeded.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        known = patterns(spark, path, before=number)
        through = links.not_blocked(batch, known).withColumn("__junk", F.coalesce(junk, F.lit(False)))
        through.persist()
        try:
            through.filter("not __junk").drop("__junk").write.mode("overwrite").parquet(f"{kept}/batch={number}")
            new = sinks.blocklist_feedback(through.filter("__junk"), known)
            new.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            through.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**({"availableNow": True} if available_now else {"processingTime": "10 seconds"})).start()
