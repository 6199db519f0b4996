"""Sinks: vendor tables as CSV, JSON and reports; registries, progress and feedback as files."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dictionaries as D
from .functions import text as X
from .functions import urls as U
from .operators import report


def export_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Fixed columns, then the extra fields by how often they are filled (distinct field names are few)."""
    if "extras" not in df.columns:
        return list(D.EXPORT_FIELDS)
    return list(D.EXPORT_FIELDS) + [(r["field"], r["header"]) for r in report.dynamic_columns(df).select("field", "header").collect()]


def export_table(df: DataFrame) -> DataFrame:
    """The sheet: headers as names, sanitised cells, missing values blank, order kept in `ord`."""
    fixed = {f for f, _ in D.EXPORT_FIELDS}
    out = []
    for field, header in export_columns(df):
        column = F.col(field) if field in df.columns else F.try_element_at("extras", F.lit(field)) if field not in fixed else F.lit("")
        out.append((F.coalesce(column.cast("string"), F.lit("")) if field == "confidence_score" else X.sanitized(column.cast("string"))).alias(header))
    return df.select("ord", *out)


def file_name(title: str, query: str = "", now: datetime | None = None, suffix: str = "csv") -> str:
    base = re.sub(r"[^\w\s-]", "", title[:60] if title else query[:40]).strip().replace(" ", "_") or "vendors"
    return f"vendors_{base}_{(now or datetime.now()):%Y%m%d_%H%M%S}.{suffix}"


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV part files with headers, in order of `ord` (range-partitioned, no single task)."""
    export_table(df).orderBy("ord").drop("ord").write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """One local file with a byte order mark, for spreadsheets; rows stream through the driver partition by partition."""
    import csv

    sheet = export_table(df).orderBy("ord").drop("ord")
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(sheet.columns)
        for row in sheet.toLocalIterator():
            out.writerow(row)


def json_rows(df: DataFrame) -> DataFrame:
    """`value`: a JSON object per record, without missing fields but always with name and source_url."""
    keep = {"name", "source_url"}
    columns = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in keep else (X.missing(F.col(c)).alias(c) if kind == "string" else F.when(F.size(c) > 0, F.col(c)).alias(c) if kind.startswith(("array", "map")) else F.col(c)) for c, kind in df.dtypes if c != "ord"]
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """vendors, statistics and duplicates as three tables below path."""
    sheet = export_table(df).withColumn("Confidence", F.concat(F.round(F.try_to_number(F.nullif("Confidence", F.lit("")), F.lit("9.999999")) * 100).cast("int").cast("string"), F.lit("%")))
    for header in ("Website", "Source URL", "LinkedIn"):
        sheet = sheet.withColumn(f"{header} Link", F.when(F.col(header).rlike("^https?://"), F.concat(F.lit('=HYPERLINK("'), F.replace(header, F.lit('"'), F.lit("%22")), F.lit('")'))))
    sheet.write.mode("overwrite").parquet(f"{path}/vendors")
    report.statistics(df).write.mode("overwrite").parquet(f"{path}/statistics")
    from .operators.records import duplicate_names

    duplicate_names(df).write.mode("overwrite").parquet(f"{path}/duplicates")


class Registry:
    """A vendor table: append-only bag, replaced as a whole after deduplication."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def register(self, rows: DataFrame) -> None:
        rows.filter(X.missing(F.col("name")).isNotNull()).write.mode("append").option("mergeSchema", True).parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.path)

    def count(self) -> int:
        return self.rows().count()

    def clear(self) -> None:
        """All rows go; the schema stays, in an empty table."""
        none = self.spark.createDataFrame([], self.rows().schema)
        none.write.mode("overwrite").parquet(self.path)

    def replaced(self, rows: DataFrame, path: str) -> Registry:
        """A new registry at another path: the old one stays until its readers are done."""
        rows.write.mode("overwrite").parquet(path)
        return Registry(self.spark, path)


def progress_name(url: str) -> str:
    import hashlib

    return f"{hashlib.md5(url.encode()).hexdigest()[:12]}.json"


def write_progress(df: DataFrame, path: str) -> None:
    """Appends rows with their 12-digit key, a folder for each session; keyed.save_progress() replaces a URL's row instead."""
    df.withColumn("key", F.substring(F.md5("url"), 1, 12)).write.mode("append").partitionBy("session_id").json(path)


def cleared_sessions(spark: SparkSession, path: str, session_id: str) -> bool:
    """Remove the progress of one session; False if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/session_id={session_id}")
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))


def partial_exports(vendors: DataFrame, path: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(vendors); if it fails, what there is is exported below path before the error goes on."""
    try:
        return run(vendors)
    except Exception:
        write_json(vendors, f"{path}/partial")
        raise


def blocklist_feedback(rejected: DataFrame, known: DataFrame) -> DataFrame:
    """New patterns from rejected URLs: first path segments of four characters and more with a junk signal."""
    segment = F.lower(F.try_element_at(U.segments(U.path(F.col("url"))), F.lit(1)))
    signal = F.col("pattern").rlike("|".join(D.BLOCKLIST_SIGNALS))
    return rejected.select(segment.alias("pattern")).filter((F.length("pattern") >= 4) & signal).distinct().join(known, "pattern", "left_anti")


class ParserCache:
    """Success counts of reviewed parsers by domain; the code itself lives in the library that holds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, domain: str, success_count: int = 0, attempt: int = 1) -> None:
        row = [(domain, re.sub(r"[^a-zA-Z0-9._-]", "_", domain), datetime.now().isoformat(), success_count, attempt)]
        self.spark.createDataFrame(row, "domain string, name string, at string, success_count int, attempt int").write.mode("append").json(self.path)

    def invalidate(self, domain: str) -> None:
        """What was saved of the domain before counts no more."""
        self.save(domain, 0, -1)

    def listed(self) -> DataFrame:
        rows = self.spark.read.schema("domain string, name string, at string, success_count int, attempt int").json(self.path)
        rows = rows.withColumn("at", F.coalesce("at", F.lit("")))
        gone = rows.filter("attempt < 0").groupBy("domain").agg(F.max("at").alias("gone"))
        rows = rows.filter("attempt >= 0").join(gone, "domain", "left").filter("gone is null or at > gone")
        return rows.groupBy("domain").agg(F.min("at").alias("created_at"), F.max("at").alias("last_used"), F.sum("success_count").alias("success_count"), F.max_by("attempt", "at").alias("attempt"))
