"""Breadth-first crawl over an edge table, by priority, with visited marked when a URL is enqueued.

Each round is a join and an aggregation; the visited and frontier tables are written to the shared
scratch folder, so a round can be repeated after a lost executor and lineage stays short. The edges lie there too.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .hooks import supervised
from .links import first_by

_own: list[tempfile.TemporaryDirectory] = []


def scratch(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="expodex-"))
    return f"file://{_own[0].name}"


def _stored(df: DataFrame) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/frontier-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _dropped(*tables: DataFrame | None) -> None:
    """Remove the files of tables made by _stored() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path is not None:
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def popped(frontier: DataFrame, size: int = 100) -> DataFrame:
    """The batch of highest priority, ties in order of entry."""
    return frontier.orderBy(F.desc("priority"), "ord").limit(size)


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int = 3, max_rounds: int = 10_000, batch: int | None = None, limit: int | None = None, failing: DataFrame | None = None, most_errors: int = 30, decide: Callable[[dict], str] | None = None) -> DataFrame:
    """url, depth, priority, round: what a crawl from the seeds (url) over edges (src, dst, kind, score) reaches.

    kind `page` and `list` keep the depth (priority 8 and 9), `link` adds one (priority 1 to 10 by
    score). A URL takes the best entry of the round that first finds it. batch: URLs crawled in a
    round by priority, the rest wait; limit: URLs crawled in all, the best of what waits; URLs that were
    found but not crawled by then are returned as well. Otherwise rounds go on until nothing waits;
    RuntimeError if something still does after max_rounds. failing: URLs (url) that give nothing but an error when
    they are crawled; rounds end when more than `most_errors` have, or when `decide`, asked where there are many errors (hooks.supervised), says `stop`. The result's files stay in the scratch folder, those of rounds do not.
    """
    rows = edges.select("src", "dst", "kind", "score").filter("src is not null and dst is not null")
    held = _stored(rows.repartition(4 * edges.sparkSession.sparkContext.defaultParallelism, "src"))  # made once, read by every round on all cores
    try:
        return _rounds(seeds, held, max_depth, max_rounds, batch, limit, failing, most_errors, decide)
    finally:
        _dropped(held)


def _rounds(seeds: DataFrame, edges: DataFrame, max_depth: int, max_rounds: int, batch: int | None, limit: int | None, failing: DataFrame | None, most_errors: int, decide: Callable[[dict], str] | None) -> DataFrame:
    """The rounds of crawl()."""
    first = seeds.filter("url is not null").select("url").distinct().select("url", F.lit(0).alias("depth"), F.lit(10).alias("priority"), F.lit(0).alias("round"))
    parts = [_stored(first)]  # visited, in parts by round
    waiting = parts[0]
    done = errors = 0
    for k in range(1, max_rounds + 1):
        visited = parts[0]
        for part in parts[1:]:
            visited = visited.unionByName(part)
        if limit is not None and done >= limit:
            return visited
        room = [n for n in (batch, None if limit is None else limit - done) if n is not None]
        now = waiting
        if room:
            now = _stored(waiting.orderBy(F.desc("priority"), "depth", "url").limit(min(room)))
            done += now.count()
        taken = now
        if failing is not None:
            bad = now.join(failing.select("url"), "url", "left_semi")
            errors += bad.count()
            now = now.join(failing.select("url"), "url", "left_anti")
        found = now.join(edges, now["url"] == edges["src"]).select(
            F.col("dst").alias("url"),
            F.when(F.col("kind") == "link", F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(F.col("kind") == "list", 9).when(F.col("kind") == "page", 8).otherwise(F.least(F.greatest(F.col("score"), F.lit(1)), F.lit(10))).alias("priority"),
        )
        found = found.filter((F.col("depth") <= max_depth) & F.col("url").isNotNull()).join(visited.select("url"), "url", "left_anti")
        new = _stored(first_by(found, ["url"], F.desc("priority"), F.col("depth")).withColumn("round", F.lit(k)))
        parts.append(new)
        if room:
            left = _stored(waiting.join(taken.select("url"), "url", "left_anti").unionByName(new))
            _dropped(taken)
        else:
            left = new
        if not any(waiting is p for p in parts):
            _dropped(waiting)
        waiting = left
        if waiting.isEmpty() or errors > most_errors or supervised({"errors": errors, "phase": "crawl", "crawled": done}, decide) == "stop":
            return visited.unionByName(new)
        if len(parts) >= 8:
            whole = _stored(visited.unionByName(new))
            _dropped(*[p for p in parts if p is not waiting])
            parts = [whole]
    raise RuntimeError(f"the crawl did not end within {max_rounds} rounds")


class Visited:
    """URLs that were seen, kept in a table in buckets by URL, to which every round appends.

    A round's links are shuffled to the same buckets once, and met there; what was seen before is read where it lies, streamed past the
    round's links, and neither shuffled nor sorted, however much it is.
    """

    def __init__(self, spark: SparkSession, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.name = f"visited_{uuid.uuid4().hex}"
        self.path = f"{scratch(spark)}/{self.name}"
        self.empty = True

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "url")

    def add(self, rows: DataFrame) -> None:
        """rows (url, depth, priority, round), dealt and distinct by URL."""
        rows.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "url").saveAsTable(self.name)
        self.empty = False

    def known(self, dealt: DataFrame) -> DataFrame:
        """The URLs of dealt rows that were seen."""
        urls = dealt.select(F.col("url").alias("__url"))
        seen = self.spark.table(self.name).select("url")
        return seen.join(urls.hint("shuffle_hash"), F.col("url") == F.col("__url"), "left_semi")

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Dealt rows, one a URL, whose URL was not seen."""
        if self.empty:
            return rows
        return rows.join(self.known(rows).hint("shuffle_hash"), "url", "left_anti")

    def rows(self) -> DataFrame:
        """All that was seen; reads files that stay when the table's name is given up."""
        return self.spark.read.schema("url string, depth int, priority int, round int").parquet(self.path)

    def close(self) -> None:
        """Give up the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def crawl_shared(seeds: DataFrame, edges: DataFrame, max_depth: int = 3, per_host: int | None = None, limit: int | None = None, buckets: int = 64, max_rounds: int = 10_000) -> DataFrame:
    """crawl() for frontiers of any size: url, depth, priority, round.

    per_host: URLs of one host that are crawled in a round, the best by priority; its others wait, so no host keeps a
    round to itself. limit: rounds end once so many URLs were crawled. Trailing slashes and blanks around URLs do not count.
    """
    clean = lambda c: F.regexp_replace(F.trim(c), "/+$", "")
    visited = Visited(seeds.sparkSession, buckets)
    links_ = edges.select(clean(F.col("src")).alias("src"), clean(F.col("dst")).alias("url"), "kind", "score").filter("src is not null and url is not null")
    first = seeds.filter("url is not null").select(clean(F.col("url")).alias("url"), F.lit(0).alias("depth"), F.lit(10).alias("priority"), F.lit(0).alias("round"))
    waiting = _stored(visited.dealt(first).dropDuplicates(["url"]))
    visited.add(visited.dealt(waiting))
    done = 0
    try:
        for k in range(1, max_rounds + 1):
            now = waiting
            if per_host is not None:
                own = Window.partitionBy(U.host(F.col("url"))).orderBy(F.desc("priority"), "depth", "url")
                now = _stored(waiting.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= per_host).drop("__n"))
            if limit is not None:
                done += now.count()
            found = now.drop("priority", "round").withColumnRenamed("url", "src").join(links_, "src").select(
                "url",
                F.when(F.col("kind") == "link", F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
                F.when(F.col("kind") == "list", 9).when(F.col("kind") == "page", 8).otherwise(F.least(F.greatest(F.col("score"), F.lit(1)), F.lit(10))).cast("int").alias("priority"),
            )
            found = visited.dealt(found.filter(F.col("depth") <= max_depth))
            best = found.groupBy("url").agg(F.min_by(F.struct("depth", "priority"), F.struct(-F.col("priority"), "depth")).alias("b")).select("url", "b.*", F.lit(k).alias("round"))
            new = _stored(visited.unseen(best))
            if per_host is not None:
                left = _stored(waiting.join(now.select("url"), "url", "left_anti").unionByName(new))
                _dropped(now)
            else:
                left = new
            if not new.isEmpty():
                visited.add(visited.dealt(new))
            if left is not new:
                _dropped(new)
            _dropped(waiting)
            waiting = left
            if waiting.isEmpty() or (limit is not None and done >= limit):
                _dropped(waiting)
                return visited.rows()
    finally:
        visited.close()
    raise RuntimeError(f"the crawl did not end within {max_rounds} rounds")
