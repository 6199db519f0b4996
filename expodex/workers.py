"""Long work in units that are committed once, so a run that was stopped goes on where it ended.

The rows to work on are dealt to units (numbers, as many as the caller says) and written once, one folder a
unit, so a wave of units reads its own folders and a later run works on the same rows. The result of each
wave goes to a folder of its own; only then does a marker, one small file, name the folder and the units that are done
in it. Readers follow the markers: what a stopped or failed wave has left is never seen, and vacuum() removes it.

A wave that fails is run again unit by unit, so one bad unit ends no other; a unit that takes too long is cancelled.
Failed units have a marker too; the next run works on them again, up to `attempts` times.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .streaming.progress import put

#: Units at once, and seconds a unit may take.
WAVE, SECONDS = 15, 600
# End of fixed values.

LEDGER = "unit int, status string, attempt string, rows long, seconds double, error string, ord long"
Work = Callable[[DataFrame], DataFrame]


class Ledger:
    """The state of one run below `path`: rows (work), results (results) and markers (ledger)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, name: str) -> bool:
        fs, where = self._fs(name)
        return bool(fs.exists(where))

    def markers(self) -> DataFrame:
        """Every marker: a row for each attempt at a unit."""
        if not self._exists("ledger"):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).option("pathGlobFilter", "[0-9]*.json").json(f"{self.path}/ledger")

    def states(self) -> DataFrame:
        """unit, status, attempt, rows, seconds, error, attempts: the last word on each unit that was tried."""
        fields = F.struct("status", "attempt", "rows", "seconds", "error")
        return self.markers().groupBy("unit").agg(F.max_by(fields, "ord").alias("s"), F.count("*").alias("attempts")).select("unit", "s.*", "attempts")

    def summary(self) -> DataFrame:
        """completed, failed, timeout, rows, seconds of the units' last states."""
        s = F.col("status")
        return self.states().agg(
            F.count_if(s == "done").alias("completed"), F.count_if(s == "error").alias("failed"), F.count_if(s == "timeout").alias("timeout"),
            F.coalesce(F.sum(F.when(s == "done", F.col("rows"))), F.lit(0)).alias("rows"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 1).alias("seconds"),
        )

    def work(self, rows: DataFrame, unit: Column) -> DataFrame:
        """The run's rows by unit; written by the first run, read as they were by later ones."""
        if not self._exists("work/_SUCCESS"):
            rows.withColumn("unit", unit.cast("int")).repartition("unit", F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.mode("overwrite").partitionBy("unit").parquet(f"{self.path}/work")
        return self.spark.read.parquet(f"{self.path}/work")

    def mark(self, units: list[int], status: str, attempt: str, rows: dict[int, int], seconds: float, error: str | None = None) -> None:
        now = time.time_ns()
        lines = [json.dumps({"unit": u, "status": status, "attempt": attempt, "rows": rows.get(u, 0), "seconds": round(seconds / len(units), 3), "error": error, "ord": now}) for u in units]
        put(self.spark, f"{self.path}/ledger", f"{now}-{uuid.uuid4().hex}.json", "\n".join(lines) + "\n")

    def results(self) -> DataFrame | None:
        """The rows of all units that are done, each from the attempt that its marker names; None before any is."""
        done = self.states().filter("status = 'done'").select("unit", "attempt")
        folders = [r["attempt"] for r in done.select("attempt").distinct().collect()]  # one a wave
        if not folders:
            return None
        base = f"{self.path}/results"
        rows = self.spark.read.option("basePath", base).option("mergeSchema", "true").parquet(*[f"{base}/attempt={a}" for a in sorted(folders)])
        return rows.join(F.broadcast(done), ["unit", "attempt"]).drop("attempt")

    def vacuum(self) -> int:
        """Remove results that no marker of a finished unit names; the number of folders that went."""
        named = {r["attempt"] for r in self.states().filter("status = 'done'").select("attempt").distinct().collect()}
        fs, where = self._fs("results")
        if not fs.exists(where):
            return 0
        gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().partition("=")[2] not in named]
        for folder in gone:
            fs.delete(folder, True)
        return len(gone)


def _attempted(ledger: Ledger, rows: DataFrame, work: Work, units: list[int], seconds: float) -> bool:
    """Work on these units and mark them; False, with nothing marked, if several units failed together."""
    sc, attempt, tag = ledger.spark.sparkContext, uuid.uuid4().hex, f"unit-{uuid.uuid4().hex}"
    late = threading.Event()

    def cancel() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds * len(units), cancel)
    began = time.monotonic()
    sc.addJobTag(tag)
    timer.start()
    try:
        made = work(rows.filter(F.col("unit").isin(units)))
        folder = f"{ledger.path}/results/attempt={attempt}"
        made.write.partitionBy("unit").parquet(folder)
        counts = {r["unit"]: r["n"] for r in ledger.spark.read.schema(made.schema).parquet(folder).groupBy("unit").agg(F.count("*").alias("n")).collect()}
    except Exception as e:  # whatever the work raises
        if len(units) > 1:
            return False
        ledger.mark(units, "timeout" if late.is_set() else "error", attempt, {}, time.monotonic() - began, str(e).partition("\n")[0][:500])
        return True
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    ledger.mark(units, "done", attempt, counts, time.monotonic() - began)
    return True


def run(rows: DataFrame, work: Work, path: str, unit: Column, wave: int = WAVE, seconds: float = SECONDS, attempts: int = 3, waves: int | None = None) -> Ledger:
    """Do `work` on the rows of every unit that is not done yet; the ledger of the run.

    unit: a small number for each row (such as a key's hash modulo the number of units); work: rows of some units,
    with the column `unit`, to its results, which keep it; wave: units that go together; waves: stop after so many.
    Null units are unit -1. Units without rows are not worked on.
    """
    ledger = Ledger(rows.sparkSession, path)
    held = ledger.work(rows, F.coalesce(unit.cast("int"), F.lit(-1)))
    known = {r["unit"]: (r["status"], r["attempts"]) for r in ledger.states().collect()}
    every = sorted(r["unit"] for r in held.select("unit").distinct().collect())  # the caller's number of units
    left = [u for u in every if u not in known or (known[u][0] != "done" and known[u][1] < attempts)]
    for k in range(0, len(left), wave):
        if waves is not None and k // wave >= waves:
            break
        units = left[k : k + wave]
        if not _attempted(ledger, held, work, units, seconds):
            for u in units:
                _attempted(ledger, held, work, [u], seconds)
    return ledger
