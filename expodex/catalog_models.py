"""Queries of foreign code and models, of tables with one row a key, and of frontiers of any size."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from . import keyed, plans
from .catalog import _row_parser
from .catalog_more import _s
from .operators import frontier, listings, parsers
from .registry import query
from .sources import snapshot
from .sources.snapshot import table


def _raising(html: str) -> list[dict]:
    raise ValueError("this site has changed")


@query("""SELECT c_custkey AS page_id, CASE WHEN c_custkey % 4 = 0 THEN 0 END::INTEGER AS ord, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS country,
 CASE c_custkey % 4 WHEN 1 THEN 'ValueError: this site has changed' WHEN 2 THEN 'no name in the first 20 rows' END AS error FROM customer WHERE c_custkey % 4 < 3""")
def parsed_in_processes(spark, d):
    """Pages of three domains by parsers in processes of their own: one works, one raises, one finds no names."""
    k = F.col("c_custkey")
    host = F.when(k % 4 == 0, "www.fair.org").when(k % 4 == 1, "changed.org").when(k % 4 == 2, "nameless.org").otherwise("unknown.org")
    html = F.concat(F.lit("<table><tr><td>"), "c_name", F.lit("</td><td>"), "c_mktsegment", F.lit("</td></tr></table>"))
    pages = table(spark, d, "customer").select(k.alias("page_id"), F.concat(F.lit("https://"), host, F.lit("/list")).alias("url"), html.alias("html"))
    rows = parsers.parsed(pages, {"fair.org": _row_parser, "changed.org": _raising, "nameless.org": lambda html: [{"country": "x"}]})
    return rows.select("page_id", "ord", "name", F.try_element_at("extras", F.lit("country")).alias("country"), "error")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS value, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END + CASE WHEN c_custkey % 6 = 0 THEN 10 ELSE 0 END::INTEGER AS n FROM customer WHERE c_custkey % 5 <> 4""")
def keyed_upserts(spark, d):
    """A table written four times: all keys, a third again (twice, the later counts), sums for a sixth, and a fifth removed."""
    t = keyed.KeyedTable(spark, f"{frontier.scratch(spark)}/keyed-{uuid.uuid4().hex}", ["k"], buckets=8)
    k = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    t.upsert(k.select("k", F.lit("first").alias("value"), F.lit(1).alias("n")))
    some = k.filter("k % 3 = 0")
    t.upsert(some.select("k", F.lit("wrong").alias("value"), F.lit(1).alias("n")).unionByName(some.select("k", F.lit("second").alias("value"), F.lit(2).alias("n"))), order=F.col("n"))
    more = k.filter("k % 6 = 0").select("k", F.lit(None).cast("string").alias("value"), F.lit(10).alias("n"))
    t.upsert(more, merged=lambda both: both.groupBy("k").agg(F.max("value").alias("value"), F.sum("n").cast("int").alias("n")))
    t.delete(k.filter("k % 5 = 4"))
    t.vacuum()
    return t.rows().select("k", "value", "n")


@query("""SELECT 'https://h' || (c_custkey % 7) || '.org/c' || c_custkey AS url, floor(log2(c_custkey + 1))::INTEGER AS depth FROM customer WHERE c_custkey < 255""")
def crawl_fair_share(spark, d):
    """A tree of pages on seven hosts, of which eight a host are crawled in a round; seven levels in all."""
    k = F.col("c_custkey")
    of = lambda c: _s("https://h", F.pmod(c, F.lit(7)), ".org/c", c)
    up = F.floor((k - 1) / 2).cast("long")
    edges = table(spark, d, "customer").filter("c_custkey > 0").select(of(up).alias("src"), F.concat(of(k), F.lit("/")).alias("dst"), F.lit("link").alias("kind"), (k % 12).cast("int").alias("score"))
    seeds = table(spark, d, "customer").filter("c_custkey = 0").select(of(k).alias("url"))
    return frontier.crawl_shared(seeds, edges, max_depth=7, per_host=8, buckets=8).select("url", "depth")


@query("""WITH n AS (SELECT c_custkey AS k, floor(log2(c_custkey + 1))::INTEGER AS level FROM customer)
SELECT 'c' || k AS url, level AS depth FROM n WHERE level < 4 OR (level = 4 AND k < 29)""")
def crawl_with_failures(spark, d):
    """A tree in which one page of the fourth level fails, and a crawl that a supervisor ends after six errors."""
    k = F.col("c_custkey")
    edges = table(spark, d, "customer").filter("c_custkey > 0").select(_s("c", F.floor((k - 1) / 2).cast("long")).alias("src"), _s("c", k).alias("dst"), F.lit("link").alias("kind"), F.lit(1).alias("score"))
    seeds = table(spark, d, "customer").filter("c_custkey = 0").select(_s("c", k).alias("url"))
    failing = table(spark, d, "customer").filter("c_custkey = 14 or c_custkey between 15 and 20").select(_s("c", k).alias("url"))
    return frontier.crawl(seeds, edges, max_depth=100, failing=failing, decide=lambda state: "stop").select("url", "depth").filter("depth < 5")


def _stand_in(texts: list[str]) -> list[str]:
    """A model that takes words beginning with `qu` for companies."""
    return [json.dumps({"is_vendor_listing": True, "vendors": [{"Name": w, "Place": "hall"} for w in re.findall(r"(?<!\S)qu[a-z]+(?!\S)", t)]}) for t in texts]


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS ws FROM documents WHERE length(text) >= 200),
t AS (SELECT doc_id, len(ws) AS n, i - 1 AS i, ws[i] AS x FROM w, unnest(range(1, len(ws) + 1)) AS u(i)),
p AS (SELECT DISTINCT doc_id, x, p FROM t, unnest(range(0, 1 + greatest(0, (n - 50 + 39) // 40))) AS v(p) WHERE regexp_full_match(x, 'qu[a-z]+') AND i >= 40 * p AND i < 40 * p + 50),
g AS (SELECT doc_id, x, p, p - lag(p, 1, p - 9) OVER (PARTITION BY doc_id, x ORDER BY p) > 1 AS starts FROM p)
SELECT doc_id AS page_id, x AS name, p AS piece, 'hall' AS place FROM g WHERE starts""")
def listing_by_model(spark, d):
    """Companies of documents by a stand-in model, in pieces of fifty words that share ten."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), "text")
    rows = listings.listed(pages, _stand_in, words=50, overlap=10)
    return rows.select("page_id", "name", F.floor(F.col("ord") / 100_000).alias("piece"), F.try_element_at("fields", F.lit("place")).alias("place"))


def _knows(texts: list[str]) -> list[str | None]:
    return ["Here: " + json.dumps({"email": f"{t.split()[1].lower()}@firm.org", "website": "" if "odd" in t else "https://told.org"}) if "find" in t else None for t in texts]


@query("""SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN 'https://own.org' WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 < 3 AND c_custkey % 2 = 0 THEN 'https://told.org' ELSE 'https://hit' || c_custkey || '.org' END AS website,
 CASE WHEN c_custkey % 3 = 0 THEN 'own@own.org' WHEN c_custkey % 5 IN (1, 2) THEN 'f' || c_custkey || '@firm.org' END AS email,
 CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'rule_based' ELSE 'rule_based+websearch' END AS extraction_method FROM customer""")
def context_enrichment(spark, d):
    """Vendors that lack most fields, filled from search hits by a stand-in model; one in three lacks little."""
    k = F.col("c_custkey")
    own = k % 3 == 0
    none = F.lit(None).cast("string")
    vendors = table(spark, d, "customer").select(
        k.alias("ord"), _s("F", k).alias("name"), F.when(own, "https://own.org").alias("website"), F.when(own, "own@own.org").alias("email"), F.when(own, "+1 555 0100").alias("phone"), F.when(own, "Makes things that are needed").alias("description"),
        none.alias("country"), none.alias("category"), none.alias("linkedin"), F.lit("https://expo.org/1").alias("source_url"), F.lit("rule_based").alias("extraction_method"),
    )
    hit = lambda n, url, said: F.struct(F.lit(n).alias("ord"), F.lit("a hit").alias("title"), url.alias("url"), said.alias("snippet"))
    said = F.when(k % 5 < 3, F.when(k % 2 == 0, "find it").otherwise("find it odd")).otherwise("nothing said")
    hits = F.explode(F.array(hit(0, F.lit("https://www.facebook.com/x"), said), hit(1, _s("https://hit", k, ".org"), F.lit(""))))
    rows = table(spark, d, "customer").filter("c_custkey % 5 > 0").select(k.alias("vendor"), hits.alias("h")).select("vendor", "h.*")
    return plans.context_enriched(vendors, rows, _knows).select("ord", "website", "email", "extraction_method")


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'cache' WHEN c_custkey % 3 = 0 THEN NULL ELSE 'fetch' END AS layer FROM customer""")
def layered_guard(spark, d):
    """Files that are no pages come from the cache or not at all."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("k"), _s("https://s.org/", k, F.when(k % 3 == 0, ".zip").otherwise("")).alias("url"), F.lit("<p>x</p>").alias("html"))
    return snapshot.layered(rows.select("k", "url"), rows.filter("k % 2 = 0"), rows, rows).select("k", "layer")
