"""Progress of streams, appended to a table while they run.

The listener writes one small JSON object a file through the file system of the table's path, which every
executor shares, and starts no job of its own. Files are written beside the table and renamed into it, so a
reader sees whole rows only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "event string, query string, run string, name string, batch long, input_rows long, output_rows long, rows_per_second double, millis long, watermark string, state_rows long, error string, at string"


def put(spark: SparkSession, folder: str, name: str, text: str, replace: bool = True) -> None:
    """A small file, whole or not at all; FileExistsError if there is one of the name and it is not to be replaced."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    half, whole = (jvm.org.apache.hadoop.fs.Path(where, n) for n in (f"_{uuid.uuid4().hex}-{name}", name))
    if fs.exists(whole):
        if not replace:
            raise FileExistsError(f"{folder}/{name}")
        fs.delete(whole, False)
    out = fs.create(half, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(half, whole):
        raise OSError(f"{whole} could not be written")


class ProgressTable(StreamingQueryListener):
    """Appends a row for each start, batch and end of the session's streams; `path` is a folder of JSON files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.running: set[str] = set()

    def _append(self, **row: object) -> None:
        row["at"] = datetime.now(timezone.utc).isoformat()
        put(self.spark, self.path, f"{row['event']}-{uuid.uuid4().hex}.json", json.dumps(row))

    def onQueryStarted(self, event) -> None:
        self.running.add(str(event.runId))
        self._append(event="started", query=str(event.id), run=str(event.runId), name=event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._append(
            event="batch", query=str(p.id), run=str(p.runId), name=p.name, batch=p.batchId, input_rows=p.numInputRows, output_rows=max(p.sink.numOutputRows, 0) if p.sink else None, rows_per_second=_finite(p.processedRowsPerSecond),
            millis=p.batchDuration, watermark=p.eventTime.get("watermark"), state_rows=sum(s.numRowsTotal for s in p.stateOperators),
        )

    def onQueryIdle(self, event) -> None:
        self._append(event="idle", query=str(event.id), run=str(event.runId))

    def onQueryTerminated(self, event) -> None:
        self._append(event="ended", query=str(event.id), run=str(event.runId), error=event.exception)
        self.running.discard(str(event.runId))


def _finite(x: float) -> float | None:
    return x if x == x and abs(x) != float("inf") else None


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "[a-z]*.json").json(path)


def progress_summary(rows: DataFrame) -> DataFrame:
    """Of each query: batches, input rows, the largest state, seconds, runs, and the last error."""
    batch = F.col("event") == "batch"
    return rows.groupBy("query").agg(
        F.max("name").alias("name"), F.count_if(batch).alias("batches"), F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"), F.coalesce(F.max("state_rows"), F.lit(0)).alias("most_state_rows"), (F.coalesce(F.sum("millis"), F.lit(0)) / 1000).alias("seconds"),
        F.count_distinct("run").alias("runs"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("at"))).alias("last_error"),
    )


@contextmanager
def watched(spark: SparkSession, path: str, patience: float = 20.0) -> Iterator[ProgressTable]:
    """While this lasts, progress of the session's streams goes to the table at path.

    Events come a little late: at the end those of streams that are over are waited for.
    """
    listener = ProgressTable(spark, path)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        until = time.monotonic() + patience
        while time.monotonic() < until and listener.running - {str(q.runId) for q in spark.streams.active}:
            time.sleep(0.05)
        spark.streams.removeListener(listener)
