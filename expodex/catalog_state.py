"""Queries of what keeps state or a ledger: caches, workers, learning blocklists, sources with offsets, suffix rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workers
from .catalog_more import _choice, _s
from .functions import urls as U
from .operators import domains, frontier, links
from .registry import query
from .sources import search, snapshot
from .sources.snapshot import table
from .streaming import cache, feedback, progress


def _folder(spark: SparkSession, name: str) -> str:
    return f"{frontier.scratch(spark)}/{name}-{uuid.uuid4().hex}"


# --- Keyed cache --------------------------------------------------------------------------------

_TTL, _MOST, _EVICT = 5 * 86400, 2, 1
_CACHED = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, false AS hit, NULL::BIGINT AS since, []::STRUCT(e VARCHAR, t BIGINT)[] AS held FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, event_id, found IS NOT NULL, coalesce(found, t), CASE WHEN found IS NOT NULL THEN live ELSE list_append(CASE WHEN len(live) > {_MOST} THEN live[{_EVICT + 1}:] ELSE live END, {{'e': event_type, 't': t}}) END
  FROM (SELECT *, list_filter(live, lambda x: x.e = event_type)[1].t AS found FROM (SELECT e.*, list_filter(s.held, lambda x: e.t - x.t < {_TTL * 1_000_000}) AS live FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
)
SELECT user_id::VARCHAR AS key, event_id, hit, since AS stored_us FROM s WHERE n > 0"""


def _requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("key"), F.col("event_type").alias("entry"), F.col("ts").alias("at"), F.col("event_id").alias("ord"))


def _answers(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("ord").alias("event_id"), "hit", F.unix_micros("stored_at").alias("stored_us"))


@query(_CACHED)
def keyed_cache(spark, d):
    """What a cache of each user's event types, of five days and three entries, answers to every event."""
    return _answers(cache.asked(_requests(table(spark, d, "events")), _TTL, _MOST, _EVICT))


@query(_CACHED)
def keyed_cache_stream(spark, d):
    """The same by keyed state of a stream, with a checkpoint, read back from its sink."""
    cache.with_state_store(spark)
    out = _folder(spark, "cache")
    answers = cache.asked_stream(_requests(snapshot.table_stream(spark, d, "events")), _TTL, _MOST, _EVICT)
    answers.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _answers(spark.read.schema(cache.ASKED).parquet(f"{out}/rows"))


# --- Workers ------------------------------------------------------------------------------------


@query("""SELECT (o_custkey % 8)::INTEGER AS unit, o_custkey, count(*) AS n, max(o_orderkey) AS last, 1::BIGINT AS attempts, 'done' AS status FROM orders GROUP BY o_custkey""")
def worker_resumed(spark, d):
    """Orders of each customer in eight units; the run is stopped after one wave of three and goes on in a second."""
    path = _folder(spark, "workers")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey")

    def work(part: DataFrame) -> DataFrame:
        return part.groupBy("unit", "o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))

    unit = F.pmod(F.col("o_custkey"), F.lit(8))
    workers.run(rows, work, path, unit, wave=3, waves=1)
    ledger = workers.run(rows, work, path, unit, wave=3)
    return ledger.results().join(F.broadcast(ledger.states().select("unit", "attempts", "status")), "unit").select("unit", "o_custkey", "n", "last", "attempts", "status")


# --- Blocklists ---------------------------------------------------------------------------------


@query(rf"""WITH p AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN 'n/' || o_orderkey ELSE lower(o_orderpriority) || o_orderkey END AS pattern FROM orders WHERE o_orderkey > 9),
u AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
SELECT page_id FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE contains(u.path, p.pattern))""")
def blocklist_index(spark, d):
    """Pages whose path holds none of as many patterns as there are orders."""
    k = F.col("o_orderkey")
    pattern = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, _s("N/", k)).otherwise(F.concat("o_orderpriority", k.cast("string")))
    patterns = table(spark, d, "orders").filter("o_orderkey > 9").select(pattern.alias("pattern"))
    return links.without_patterns(table(spark, d, "pages").select("page_id", "url"), patterns).select("page_id")


_LEARN = """WITH c AS (SELECT c_custkey, c_custkey % 3 AS b, c_custkey % 11 = 0 AS junk, CASE WHEN c_custkey % 2 = 0 THEN 'booking-' || (c_custkey % 37) || '-x' ELSE 'hall-' || (c_custkey % 37) END AS seg FROM customer),
b0 AS (SELECT * FROM c WHERE b = 0), p0 AS (SELECT DISTINCT seg FROM b0 WHERE junk AND contains(seg, 'booking')),
b1 AS (SELECT * FROM c WHERE b = 1 AND seg NOT IN (SELECT seg FROM p0)), p1 AS (SELECT seg FROM p0 UNION SELECT seg FROM b1 WHERE junk AND contains(seg, 'booking')),
b2 AS (SELECT * FROM c WHERE b = 2 AND seg NOT IN (SELECT seg FROM p1))
SELECT c_custkey, b::INTEGER AS batch FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2) WHERE NOT junk"""


@query(_LEARN)
def blocklist_learned(spark, d):
    """Three batches of URLs; junk that one lets through is blocked in the next."""
    path = _folder(spark, "learning")
    k = F.col("c_custkey")
    segment = F.when(k % 2 == 0, _s("Booking-", k % 37, "-x")).otherwise(_s("hall-", k % 37))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("https://expo.org/"), segment, F.lit("/"), k.cast("string")).alias("url"))
    for batch in range(3):
        rows.filter(k % 3 == batch).write.parquet(f"{path}/in/{batch}")
    feedback.seeded(spark.createDataFrame([], "pattern string"), f"{path}/patterns")
    for batch in range(3):  # each folder is a batch of its own
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{path}/in/[0-{batch}]")
        feedback.learning(stream, F.col("c_custkey") % 11 == 0, f"{path}/patterns", f"{path}/kept", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("c_custkey long, url string, batch int").parquet(f"{path}/kept").select("c_custkey", "batch")


# --- Sources ------------------------------------------------------------------------------------

_FOUND = """SELECT o_orderpriority AS query, o_orderstatus AS engine, 'r' || (o_orderkey % 3) AS region, i::INTEGER AS ord, 'Order ' || o_orderkey AS title, 'https://s' || i || '.org/' || o_orderkey AS url, CASE WHEN i = 0 THEN left(repeat('x', o_orderkey % 400), 300) ELSE '' END AS snippet
FROM orders, unnest(range(0, 2)) AS u(i) WHERE o_orderstatus = 'F' AND o_orderkey % 3 IN (0, 2)"""


def _saved_pages(spark: SparkSession, d: str, path: str) -> None:
    k = F.col("o_orderkey")
    hit = lambda i, snippet: F.struct(_s("Order ", k).alias("title"), _s(f"https://s{i}.org/", k).alias("url"), snippet.alias("snippet"))
    none = F.struct(F.lit("no place").alias("title"), F.lit(None).cast("string").alias("url"), F.lit("").alias("snippet"))
    hits = F.array(hit(0, F.repeat(F.lit("x"), (k % 400).cast("int"))), hit(1, F.lit(None).cast("string")), none)
    pages = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query"), F.col("o_orderstatus").alias("engine"), _s("r", k % 3).alias("region"), F.when(k % 2 == 0, hits).alias("organic"), F.when(k % 2 == 1, hits).alias("results"))
    pages.write.partitionBy("engine").json(path)


@query(_FOUND)
def search_source_pushed(spark, d):
    """Hits of saved result pages: the engine chooses files, the region is filtered by the reader."""
    path = _folder(spark, "search")
    _saved_pages(spark, d, path)
    search.registered(spark)
    return spark.read.format("expodex_search").load(path).filter("engine = 'F' AND region IN ('r0', 'r2')")


@query(_FOUND)
def search_source_stream(spark, d):
    """The same pages as a stream with offsets, kept as Parquet by engine and read with filters on it."""
    path = _folder(spark, "search")
    _saved_pages(spark, d, f"{path}/in")
    search.registered(spark)
    stream = spark.readStream.format("expodex_search").load(f"{path}/in")
    stream.writeStream.format("parquet").option("path", f"{path}/hits").option("checkpointLocation", f"{path}/checkpoint").partitionBy("engine").trigger(availableNow=True).start().awaitTermination()
    return snapshot.search_table(spark, f"{path}/hits").filter("engine = 'F' AND region IN ('r0', 'r2')")


# --- Registered domains -------------------------------------------------------------------------

_RULES = ["com", "co.uk", "uk", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "github.io", "io", "a.b.c.org"]
_NAMES = ["x.y.com", "com", "a.co.uk", "co.uk", "Shop.A.co.uk:8080", "b.www.ck", "www.ck", "a.b.ck", "b.ck", "ck", "p.q.r.kawasaki.jp", "r.kawasaki.jp", "t.city.kawasaki.jp", "city.kawasaki.jp", "me.github.io", "github.io", "one", "x.a.b.c.org", "b.c.org", "unknown.zz.", "10.0.0.1", ""]
#: What those are, judged by hand.
_JUDGED = ["y.com", None, "a.co.uk", None, "a.co.uk", "www.ck", "www.ck", "a.b.ck", None, None, "q.r.kawasaki.jp", None, "city.kawasaki.jp", "city.kawasaki.jp", "me.github.io", None, None, "x.a.b.c.org", "c.org", "unknown.zz", "10.0.0.1", None]
_BY_HAND = ", ".join(f"({k}, {'NULL' if r is None else chr(39) + r + chr(39)})" for k, r in enumerate(_JUDGED))


@query(rf"""WITH j(k, r) AS (VALUES {_BY_HAND}), h AS (SELECT DISTINCT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM pages),
p AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS registered FROM h)
SELECT o_orderkey AS id, r AS registered FROM orders JOIN j ON o_orderkey % {len(_NAMES)} = k UNION ALL SELECT page_id, p.registered FROM pages JOIN p ON p.host = lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))""")
def registered_domain_rules(spark, d):
    """Hosts of pages and of orders by suffix rules with wildcards and exceptions."""
    rules = spark.createDataFrame([(r,) for r in _RULES], "rule string")
    hosts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _choice("o_orderkey", _NAMES).alias("host")).unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id"), U.host(F.col("url")).alias("host")))
    return hosts.join(domains.registered_domains(hosts, rules), "host").select("id", "registered")


# --- Progress -----------------------------------------------------------------------------------


@query("SELECT 'hours' AS name, count(*)::BIGINT AS input_rows, 1::BIGINT AS runs, count(*) = 0 AS failed FROM events")
def stream_progress(spark, d):
    """What a listener wrote down of a stream over the events."""
    path = _folder(spark, "progress")
    with progress.watched(spark, f"{path}/progress"):
        hours = snapshot.table_stream(spark, d, "events").select(F.date_trunc("hour", "ts").alias("hour"))
        hours.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").queryName("hours").trigger(availableNow=True).start().awaitTermination()
    told = progress.progress_summary(progress.progress_rows(spark, f"{path}/progress"))
    return told.select("name", "input_rows", "runs", F.col("last_error").isNotNull().alias("failed"))
