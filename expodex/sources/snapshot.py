"""Offline sources. Whatever needs the network is fetched elsewhere and read here as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import scoring
from ..functions import urls as U
from ..operators.links import first_by
from ..operators.records import deduplicated_seeds
from .search import SCHEMA as SEARCH_SCHEMA  # noqa: F401
from .search import SearchSource  # noqa: F401

PROGRESS_SCHEMA = "url string, session_id string, last_updated string, status string, vendors_found int, pages_crawled int, errors int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over all cores by a hash of a key that rarely repeats, before work that is long for each row: a file of few bytes and many rows is one task."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, one file or a folder of them, as a stream; a path with a pattern is read as it is."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


_HITS = "array<struct<title:string,url:string,snippet:string>>"
_PAGE = f"query string, engine string, region string, organic {_HITS}, results {_HITS}"


def hits_of(pages: DataFrame, limit: int = 30) -> DataFrame:
    """Result pages (query, engine, region, organic, results) -> SEARCH_SCHEMA; hits without a URL go."""
    hits = pages.select("query", "engine", "region", F.posexplode(F.coalesce("organic", "results", F.array().cast(_HITS))).alias("ord", "r"))
    out = hits.select("query", "engine", "region", "ord", F.coalesce("r.title", F.lit("")).alias("title"), "r.url", F.left(F.coalesce("r.snippet", F.lit("")), F.lit(300)).alias("snippet"))
    return out.filter(F.coalesce("url", F.lit("")) != "").filter(F.col("ord") < limit)


def search_results(spark: SparkSession, path: str, limit: int = 30) -> DataFrame:
    """Saved result pages, one JSON object a line with `organic` or `results`."""
    return hits_of(spark.read.schema(_PAGE).json(path), limit)


def search_stream(spark: SparkSession, path: str, limit: int = 30, files_a_batch: int | None = None) -> DataFrame:
    """search_results() of the files that arrive in a folder; any store that Spark opens."""
    reader = spark.readStream.schema(_PAGE)
    return hits_of((reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).json(path), limit)


def search_table(spark: SparkSession, path: str) -> DataFrame:
    """Hits kept as Parquet by engine (write_search()): filters on engine choose folders, others reach the scan."""
    return spark.read.schema(SEARCH_SCHEMA).parquet(path)


def write_search(hits: DataFrame, path: str) -> None:
    hits.select(*[c.split()[0] for c in SEARCH_SCHEMA.split(", ")]).write.mode("append").partitionBy("engine").parquet(path)


def first_non_empty(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """Cascade of sources: of each key the value of the first source that has one."""
    every = None
    for k, df in enumerate(sources):
        own = df.select(F.col(key), F.col(value)).filter(F.coalesce(F.trim(F.col(value)), F.lit("")) != "").withColumn("__source", F.lit(k))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(key).agg(F.min_by(value, F.struct("__source", value)).alias(value), F.min("__source").alias("source"))


def fetched(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """wanted (url) joined to the snapshot by cache key, a row each; `success` says whether the page is held.

    Of pages whose URLs have one key (they differ by case, blanks or a final slash) the first by URL that has a text counts.
    held_pages, held_texts and held_chars say how many pages have the key, how many of those a text, and how long the texts are together.
    """
    key = U.cache_key(F.regexp_replace("url", "/+$", ""))
    order = F.struct(F.when(F.col("html").isNull(), 1).otherwise(0), "url", "html")
    held = pages.filter("url is not null").groupBy(key.alias("__key")).agg(F.min_by(F.struct("url", "html"), order).alias("__p"), F.count("*").alias("__n"), F.count("html").alias("__t"), F.sum(F.length("html")).alias("__c"))
    rows = wanted.withColumn("__key", key).join(held, "__key", "left")
    out = rows.select(*wanted.columns, F.col("__p.url").alias("final_url"), F.col("__p.html").alias("html"), *[F.coalesce(c, F.lit(0).cast("long")).alias(n) for c, n in (("__n", "held_pages"), ("__t", "held_texts"), ("__c", "held_chars"))])
    return out.withColumn("success", F.col("html").isNotNull()).withColumn("text_length", F.coalesce(F.length("html"), F.lit(0)))


def robots_rules(text: Column) -> Column:
    """struct(crawl_delay double, disallowed array<string>): the first delay and at most 50 paths."""
    lines = F.split(text, r"\r?\n")
    paths = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"(?i)^\s*disallow\s*:\s*([^#]*)", 1))), lambda p: p != "")
    delay = F.try_element_at(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"(?i)^\s*crawl-delay\s*:\s*([0-9]+(?:\.[0-9]+)?)", 1)), lambda d: d != ""), F.lit(1))
    return F.struct(delay.cast("double").alias("crawl_delay"), F.slice(paths, 1, 50).alias("disallowed"))


def robots_allow(text: Column, path: Column) -> Column:
    return ~F.exists(robots_rules(text)["disallowed"], lambda p: path.startswith(p))


def sitemap_locs(xml: Column) -> Column:
    """All <loc> values in order, whatever the namespace; malformed documents are read as far as they go."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:[A-Za-z0-9]+:)?loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:[A-Za-z0-9]+:)?loc>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&"))), lambda x: x != "")


def is_sitemap_index(locs: Column) -> Column:
    return F.size(F.filter(locs, lambda x: F.lower(x).endswith(".xml"))) > F.size(locs) * 0.5


def progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS_SCHEMA).json(path)


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("blocked_path_patterns array<string>").option("multiLine", "true").json(path)
    return raw.select(F.explode("blocked_path_patterns").alias("pattern")).filter("pattern <> ''").distinct()


# Searches over saved hits (query, ord, title, url, snippet): what the network returned is data here.

#: The shapes of a directory search, of a company search, and where sitemaps are looked for.
DIRECTORY_SHAPES = ["{query} exhibitor list {year}", "{query} vendor directory {region}", "{query} companies participating {year}"]
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-exhibitors.xml", "/exhibitors-sitemap.xml"]
# End of fixed values.


def scored_hits(hits: DataFrame, queries: list[str], each: int, most: int) -> DataFrame:
    """The best `most` of the first `each` hits of every query, scored and deduplicated in the order of queries and hits."""
    asked = F.array_position(F.array(*[F.lit(q) for q in queries]), F.col("query"))
    rows = hits.withColumn("__asked", asked).filter((F.col("__asked") > 0) & (F.coalesce("url", F.lit("")) != ""))
    n = F.row_number().over(Window.partitionBy("query").orderBy("ord", "url"))
    rows = rows.withColumn("__n", n).filter(F.col("__n") <= each).withColumn("ord", (F.col("__asked") * 1000 + F.col("__n")).cast("int"))
    rows = rows.withColumn("score", scoring.seed_score(F.col("url"), F.col("title"), F.col("snippet"))).drop("__asked", "__n")
    return deduplicated_seeds(rows).orderBy(F.desc("score"), "ord").limit(most)


def fallback_results(hits: DataFrame, query: str, most: int = 40) -> DataFrame:
    """Seed discovery by the first six templates, fifteen hits each, for when regional engines give nothing."""
    return scored_hits(hits, [t.replace("{query}", query) for t in D.SEARCH_TEMPLATES[:6]], 15, most)


def directory_results(hits: DataFrame, query: str, region: str = "global", year: str = "2025 2026", each: int = 15, most: int = 30) -> DataFrame:
    """The best hits of three searches for exhibitor lists."""
    shapes = [x.replace("{query}", query).replace("{region}", region).replace("{year}", year) for x in DIRECTORY_SHAPES]
    return scored_hits(hits, shapes, each, most)


def company_facts(hits: DataFrame, key: str) -> DataFrame:
    """key, linkedin, description, n: of each company's hits the first company profile, the first snippet (300 characters) and their number."""
    linked, said = F.col("url").contains("linkedin.com/company"), F.coalesce("snippet", F.lit("")) != ""
    return hits.groupBy(key).agg(
        F.min_by("url", F.when(linked, F.col("ord"))).alias("linkedin"), F.left(F.min_by("snippet", F.when(said, F.col("ord"))), F.lit(300)).alias("description"), F.count("*").alias("n")
    )


def search_context(hits: DataFrame, key: str, skipped: list[str] = D.SKIP_DOMAINS) -> DataFrame:
    """key, best_url, context: of each company's first six hits the first URL outside the skipped domains, and four snippets (else titles) of 200 characters."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("ord", "url"))
    rows = hits.withColumn("__n", n).filter("__n <= 6")
    fine = (F.coalesce("url", F.lit("")) != "") & ~U.host(F.col("url")).rlike("|".join(d.replace(".", r"\.") for d in skipped))
    said = F.left(F.coalesce(F.nullif("snippet", F.lit("")), F.nullif("title", F.lit(""))), F.lit(200))
    lines = F.slice(F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct(F.col("__n").alias("n"), said.alias("t"))))), lambda x: x["t"]), 1, 4)
    return rows.groupBy(key).agg(F.min_by("url", F.when(fine, F.col("__n"))).alias("best_url"), F.array_join(lines, "\n").alias("context"))


def distinct_by_region(hits: DataFrame) -> DataFrame:
    """The first hit of each URL in each region, in the order of ord."""
    return first_by(hits, ["region", "url"], F.col("ord"))


# Pages: lookups in the snapshot instead of requests.


def fetchable(wanted: DataFrame, most: int = 500) -> DataFrame:
    """(ord, url): a batch to fetch, the first of each URL, without files that are no pages; `most` by ord."""
    rows = wanted.filter((F.coalesce("url", F.lit("")) != "") & ~U.has_ignored_extension(F.col("url")))
    return rows.groupBy("url").agg(F.min("ord").alias("ord")).select("ord", "url").orderBy("ord").limit(most)


def layered(wanted: DataFrame, cached: DataFrame, fetched_now: DataFrame, rendered: DataFrame | None = None, also: Sequence[str] = ()) -> DataFrame:
    """wanted (url) with the page of the first layer that holds it: cache, fetch, render (each url, html); `layer` says which, NULL if none does.

    Files that are no pages, by their extension, are taken from the cache alone: they are neither fetched nor rendered.
    also: columns of all of them that must agree beside the URL, where different pages share one.
    """
    every = None
    for k, (name, df) in enumerate((("cache", cached), ("fetch", fetched_now), ("render", rendered))):
        if df is not None:
            own = df.filter(F.coalesce(F.trim("html"), F.lit("")) != "")
            own = own if k == 0 else own.filter(~U.has_ignored_extension(F.col("url")))
            own = own.select(*also, U.cache_key(F.regexp_replace("url", "/+$", "")).alias("__key"), F.struct(F.lit(k).alias("k"), F.lit(name).alias("layer"), "html").alias("p"))
            every = own if every is None else every.unionByName(own)
    held = every.groupBy(*also, "__key").agg(F.min("p").alias("p"))
    rows = wanted.withColumn("__key", U.cache_key(F.regexp_replace("url", "/+$", "")))
    return rows.join(held, [*also, "__key"], "left").select(*wanted.columns, F.col("p.html").alias("html"), F.col("p.layer").alias("layer"))


def fresh(cached: DataFrame, now: Column, seconds: int = 3600, most: int | None = 5000) -> DataFrame:
    """Cached rows (url, cached_at) that are not older than that; beyond `most` of them the latest stay."""
    rows = cached.filter(F.unix_timestamp(now) - F.unix_timestamp("cached_at") < seconds)
    return rows if most is None else rows.orderBy(F.desc("cached_at"), "url").limit(most)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(url, markdown) of pages and documents that a reader has turned to text, one JSON object a line; of a URL the longest text."""
    raw = spark.read.schema("url string, markdown string").json(path).filter("url is not null and trim(coalesce(markdown, '')) <> ''")
    return raw.groupBy("url").agg(F.max_by("markdown", F.struct(F.length("markdown"), "markdown")).alias("markdown"))


def redirected(rows: DataFrame, redirects: DataFrame, hops: int = 5) -> DataFrame:
    """rows (url) with final_url, followed through (src, dst) at most `hops` times; of several targets the least, and a loop ends where it began."""
    to = redirects.filter("src is not null and dst is not null and src <> dst").groupBy(F.col("src").alias("__src")).agg(F.min("dst").alias("__dst"))
    out = rows.withColumn("final_url", F.col("url"))
    for _ in range(hops):
        out = out.join(to, out["final_url"] == to["__src"], "left").withColumn("final_url", F.coalesce(F.when(F.col("__dst") != F.col("url"), F.col("__dst")), "final_url")).drop("__src", "__dst")
    return out


def sitemap_urls(sites: DataFrame, files: DataFrame, most_parts: int = 10) -> DataFrame:
    """(site, root) and saved XML files (url, xml) -> site, ord, url: the locations of each site's sitemaps.

    The four usual places are looked at in turn; an index (more than half of it XML files) is followed
    one level, to its first `most_parts` files. The first place of each location counts.
    """
    places = F.posexplode(F.array(*[F.lit(p) for p in SITEMAP_PATHS])).alias("place", "path")
    looked = sites.select("site", "root", places).select("site", "place", F.concat("root", "path").alias("url"))
    read = files.select(F.col("url").alias("url"), sitemap_locs(F.col("xml")).alias("locs"))
    top = looked.join(read, "url").withColumn("index", is_sitemap_index(F.col("locs")))
    plain = top.filter("not index").select("site", "place", F.lit(0).alias("part"), F.posexplode("locs").alias("n", "url"))
    parts = F.slice(F.filter("locs", lambda x: F.lower(x).endswith(".xml")), 1, most_parts)
    below = top.filter("index").select("site", "place", F.posexplode(parts).alias("part", "url")).join(read, "url").select("site", "place", "part", F.posexplode("locs").alias("n", "loc")).withColumnRenamed("loc", "url")
    every = plain.unionByName(below).withColumn("__at", F.struct("place", "part", "n"))
    first = every.groupBy("site", "url").agg(F.min("__at").alias("__at"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("__at", "url"))).select("site", "ord", "url")
