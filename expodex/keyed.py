"""Tables with one row a key: a second write of a key replaces the first, whole or not at all.

Rows lie in buckets by a hash of the key. A write reads the buckets that its keys fall into, merges, writes those
buckets to a folder of the new version, and then puts a manifest (which folder holds which bucket) beside the old
one. Readers follow the manifest of the highest number, so a write that fails leaves everything as it was; of two writes at once
one fails. vacuum() removes folders that the last manifest does not name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .streaming.progress import put


class KeyedTable:
    """keys: columns that name a row, none of them null in rows that are written; buckets: fixed when the table begins."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _fs(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _numbers(self) -> list[int]:
        fs, where = self._fs("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        """The table's state: version, buckets, schema, and the folder that each bucket was last written to."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "buckets": self.buckets, "schema": None, "held": {}}
        lines = self.spark.read.text(f"{self.path}/manifests/{numbers[-1]:012d}.json", wholetext=True).collect()
        return json.loads(lines[0]["value"])

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _read(self, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        held = {int(b): v for b, v in manifest["held"].items() if only is None or int(b) in only}
        if manifest["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(manifest["schema"])
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(held.items())])

    def rows(self) -> DataFrame | None:
        """The table's rows; None before the first write."""
        return self._read(self.manifest())

    def _commit(self, manifest: dict, held: dict, schema: dict) -> None:
        version = manifest["version"] + 1
        text = json.dumps({"version": version, "buckets": manifest["buckets"], "schema": schema, "held": held})
        put(self.spark, f"{self.path}/manifests", f"{version:012d}.json", text, replace=False)

    def _written(self, manifest: dict, rows: DataFrame, touched: list[int]) -> dict:
        """Write the rows of these buckets to a folder of this write's own; bucket -> folder of all that then hold rows."""
        folder, n = f"{manifest['version'] + 1:012d}-{uuid.uuid4().hex}", manifest["buckets"]
        rows.repartition(min(len(touched), n), self._bucket(n)).withColumn("bucket", self._bucket(n)).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        fs, where = self._fs(f"data/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        made = {int(x.partition("=")[2]) for x in names if x.startswith("bucket=")}
        held = {b: v for b, v in manifest["held"].items() if int(b) not in touched}
        return held | {str(b): folder for b in sorted(made)}

    def upsert(self, new: DataFrame, order: Column | None = None, merged: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Rows of new keys are added, those of known keys replace what is held.

        order: which of several rows of a key is written (the highest; ties by the row itself). merged: instead, makes one row a key of
        the held and new rows together, where `__new` says which are new; it must return the table's columns.
        """
        manifest = self.manifest()
        n = manifest["buckets"]
        new = new.filter(" and ".join(f"`{k}` is not null" for k in self.keys))
        touched = [r["b"] for r in new.select(self._bucket(n).alias("b")).distinct().collect()]  # n at most
        if not touched:
            return
        old = self._read(manifest, touched)
        if merged is not None:
            both = new.withColumn("__new", F.lit(True))
            both = both if old is None else old.withColumn("__new", F.lit(False)).unionByName(both, allowMissingColumns=True)
            out = merged(both)
        else:
            others = [c for c in new.columns if c not in self.keys]
            by = F.struct(*([order.alias("o")] if order is not None else []), F.to_json(F.struct(*others)).alias("r")) if others else F.lit(0)
            out = new.groupBy(*self.keys).agg(F.max_by(F.struct(*others), by).alias("r")).select(*self.keys, "r.*").select(*new.columns) if others else new.distinct()
            if old is not None:
                out = old.join(out.select(*self.keys), self.keys, "left_anti").unionByName(out, allowMissingColumns=True)
        self._commit(manifest, self._written(manifest, out, touched), out.schema.jsonValue())

    def delete(self, gone: DataFrame) -> None:
        """Rows of these keys go."""
        manifest = self.manifest()
        n = manifest["buckets"]
        touched = [r["b"] for r in gone.select(self._bucket(n).alias("b")).distinct().collect() if str(r["b"]) in manifest["held"]]
        if touched:
            left = self._read(manifest, touched).join(gone.select(*self.keys), self.keys, "left_anti")
            self._commit(manifest, self._written(manifest, left, touched), manifest["schema"])

    def vacuum(self) -> int:
        """Remove the files that the last manifest does not name and the manifests before it, while nobody writes; the number of buckets that went."""
        manifest = self.manifest()
        named = {(folder, int(b)) for b, folder in manifest["held"].items()}
        fs, where = self._fs("data")
        gone = 0
        for version in fs.listStatus(where) if fs.exists(where) else []:
            folder, left = version.getPath().getName(), 0
            for s in fs.listStatus(version.getPath()):
                name = s.getPath().getName()
                if name.startswith("bucket="):
                    if (folder, int(name.partition("=")[2])) in named:
                        left += 1
                    else:
                        fs.delete(s.getPath(), True)
                        gone += 1
            if not left:
                fs.delete(version.getPath(), True)
        for k in self._numbers()[:-1]:
            fs, where = self._fs(f"manifests/{k:012d}.json")
            fs.delete(where, False)
        return gone


def progress_table(spark: SparkSession, path: str) -> KeyedTable:
    """Progress of workers, one row a session and URL: the last that was written."""
    return KeyedTable(spark, path, ["session_id", "url"])


def save_progress(table: KeyedTable, rows: DataFrame) -> None:
    """(url, session_id, last_updated and more): of each session and URL the latest."""
    table.upsert(rows, order=F.col("last_updated"))


class ParserLibrary:
    """Reviewed parsers by domain: their code and how often each succeeded; saving a domain again begins its count anew."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = KeyedTable(spark, path, ["domain"])

    def save(self, parsers: DataFrame) -> None:
        """(domain, code)"""
        own = parsers.select("domain", "code", F.current_timestamp().alias("created_at"), F.lit(0).cast("long").alias("successes"), F.lit(None).cast("timestamp").alias("last_used"))
        self.table.upsert(own)

    def succeeded(self, counts: DataFrame) -> None:
        """(domain, n): n successes more of domains that are held; others are not added."""
        new = counts.groupBy("domain").agg(F.sum("n").cast("long").alias("successes")).withColumn("last_used", F.current_timestamp())

        def merged(both: DataFrame) -> DataFrame:
            old = lambda c: F.max(F.when(~F.col("__new"), F.col(c))).alias(c)
            rows = both.groupBy("domain").agg(old("code"), old("created_at"), F.sum("successes").alias("successes"), F.max("last_used").alias("last_used"))
            return rows.filter("created_at is not null")

        if self.table.rows() is not None:
            self.table.upsert(new, merged=merged)

    def invalidate(self, domains: DataFrame) -> None:
        """(domain)"""
        self.table.delete(domains)

    def rows(self) -> DataFrame | None:
        return self.table.rows()
