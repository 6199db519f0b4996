"""Queries of keys that repeat, hosts that are shared, limits and sitemaps: what a table holds more than once."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import plans
from .catalog_more import _s
from .operators import frontier, links, pdf, records
from .registry import query
from .sources import snapshot
from .sources.snapshot import table


@query("""WITH h AS (SELECT c_custkey, 'https://S.org/P' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '/' ELSE '' END AS final_url, CASE WHEN c_custkey % 4 < 3 THEN 'page ' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN ' b' ELSE ' a' END END AS html FROM customer)
SELECT o_orderkey, c_custkey IS NOT NULL AND html IS NOT NULL AS success, CASE WHEN html IS NOT NULL OR c_custkey IS NOT NULL THEN final_url END AS final_url, html FROM orders LEFT JOIN h ON c_custkey = o_custkey AND o_orderkey % 5 > 0""")
def fetched_variants(spark, d):
    """Pages of one address with and without a final slash, some without a text: one answer for each order."""
    k = F.col("c_custkey")
    url = lambda tail: _s("https://S.org/P", k, tail)
    page = lambda tail, url: table(spark, d, "customer").select(url.alias("url"), tail.alias("html"))
    plain = page(F.when((k % 4 == 1) | (k % 4 == 2), _s("page ", k, " a")), url(""))  # no text for k % 4 = 0 and 3
    slash = page(F.when(k % 4 == 0, _s("page ", k, " b")).when(k % 4 == 1, _s("page ", k, " c")), url("/"))
    wanted = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, _s(" https://s.org/p", F.col("o_custkey"), "/")).otherwise("https://s.org/none").alias("url"))
    return snapshot.fetched(wanted, plain.unionByName(slash).unionByName(plain)).select("o_orderkey", "success", "final_url", "html")


@query("""WITH k AS (SELECT c_custkey AS k, 'https://e.org/' || (c_custkey // 3) || '.pdf' AS source_url, 'Expo ' || c_custkey || ' Exhibition' AS event_name FROM customer)
SELECT source_url, event_name, 'Firm ' || k || '-' || i AS name, CASE WHEN i = 1 THEN 'Japan' ELSE 'Turkey' END AS country, 'pdf_table' AS extraction_method FROM k, unnest(range(1, 4)) AS u(i) WHERE k % 2 = 0
UNION ALL SELECT source_url, event_name, 'Works ' || k || '-' || i, CASE WHEN i = 1 THEN 'France' ELSE 'Germany' END, 'pdf_rule_based' FROM k, unnest(range(1, 3)) AS u(i) WHERE k % 2 = 1""")
def pdf_repeated_urls(spark, d):
    """Three documents share each address, and each is saved twice: every document's own rows, once."""
    k = F.col("c_custkey")
    listed = F.concat(F.lit("| COMPANY | COUNTRY |\n|---|---|"), *[_s("\n| Firm ", k, f"-{i} | {c} |") for i, c in ((1, "JAPAN"), (2, "Turkey"), (3, "TURKEY"))])
    numbered = F.concat(_s("1 Works ", k, "-1  France"), _s("\n\n2 Works ", k, "-2  Germany"))
    body = F.concat(_s("Expo ", k, " Exhibition\n\n"), F.when(k % 2 == 0, listed).otherwise(numbered))
    docs = table(spark, d, "customer").select(_s("https://e.org/", F.floor(k / 3).cast("long"), ".pdf").alias("url"), body.alias("markdown"))
    return pdf.vendors(docs.unionByName(docs)).select("source_url", "event_name", "name", "country", "extraction_method")


_ANSWERS = """a AS (SELECT o_custkey AS k, o_orderkey AS o, CASE WHEN o_orderkey % 3 = 0 THEN 'https://w' || o_orderkey || '.org' END AS website, CASE WHEN o_orderkey % 2 = 0 THEN 'm' || o_orderkey || '@b.org' END AS email, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '+49 30 ' || (1000000 + o_orderkey) END AS phone FROM orders),
f AS (SELECT k, arg_min(website, o) FILTER (website IS NOT NULL) AS website, arg_min(email, o) FILTER (email IS NOT NULL) AS email, arg_min(phone, o) FILTER (phone <> '') AS phone FROM a GROUP BY k)"""


@query(f"""WITH {_ANSWERS} SELECT c_custkey AS ord, CASE WHEN c_custkey % 4 = 0 THEN 'https://own.org' ELSE website END AS website, email, phone FROM customer LEFT JOIN f ON k = c_custkey""")
def enriched_answers(spark, d):
    """Several answers a vendor, each with gaps: of every field the first that is there, in the order of the answers."""
    o = F.col("o_orderkey")
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("ord"), o.alias("o"), F.when(o % 3 == 0, _s("https://w", o, ".org")).alias("website"), F.when(o % 2 == 0, _s("m", o, "@b.org")).alias("email"), F.when(o % 5 == 0, "").otherwise(_s("+49 30 ", o + 1000000)).alias("phone"))
    vendors = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 4 == 0, "https://own.org").alias("website"), F.lit(None).cast("string").alias("email"), F.lit("").alias("phone"))
    return records.enriched(vendors, found, "ord", fields=["website", "email", "phone"], order=F.col("o"))


@query(f"""WITH {_ANSWERS} SELECT c_custkey AS ord, website, email, phone, 'rule_based' || CASE WHEN coalesce(website, email, phone) IS NOT NULL THEN '+websearch' ELSE '' END AS extraction_method FROM customer LEFT JOIN f ON k = c_custkey""")
def websearch_answers(spark, d):
    o = F.col("o_orderkey")
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("ord"), o.alias("o"), F.when(o % 3 == 0, _s("https://w", o, ".org")).alias("website"), F.when(o % 2 == 0, _s("m", o, "@b.org")).alias("email"), F.when(o % 5 == 0, "").otherwise(_s("+49 30 ", o + 1000000)).alias("phone"))
    none = F.lit(None).cast("string")
    vendors = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), none.alias("website"), none.alias("email"), F.lit("").alias("phone"), F.lit("rule_based").alias("extraction_method"))
    return records.websearch_filled(vendors, found, "ord", order=F.col("o"))


@query("""SELECT c_custkey AS ord, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'mail@firm' || c_custkey || '.com' END AS email FROM customer""")
def domain_enrichment_shared(spark, d):
    """Vendors found by a page of their registered domain; hosts that many share, and the source's own, say nothing."""
    k = F.col("c_custkey")
    website = F.when(k % 4 == 0, _s("https://shop.firm", k, ".com/x")).when(k % 4 == 1, _s("https://firm", k, ".com")).when(k % 4 == 2, _s("https://www.facebook.com/firm", k)).otherwise(_s("https://list.expo.org/firm", k))
    vendors = table(spark, d, "customer").select(k.alias("ord"), F.col("c_name").alias("name"), website.alias("website"), F.lit("https://www.expo.org/list").alias("source_url"), F.lit(None).cast("string").alias("email"), F.lit("rule_based").alias("extraction_method"))
    own = table(spark, d, "customer").select(k.alias("page_id"), _s("https://www.firm", k, ".com/").alias("url"), _s("<h1>Firm ", k, "</h1><p>mail@firm", k, ".com</p>").alias("html"))
    hosts = [(-1 - n, f"https://{h}/", f"<h1>Host</h1><p>press@{h}</p>") for n, h in enumerate(("www.facebook.com", "list.expo.org"))]
    pages = own.unionByName(spark.createDataFrame(hosts, own.schema))
    return plans.domain_enriched(vendors, pages).select("ord", "email")


@query("""WITH n AS (SELECT c_custkey AS k, floor(log2(c_custkey + 1))::INTEGER AS level, CASE WHEN c_custkey = 0 THEN 10 ELSE least(greatest(c_custkey % 12, 1), 10)::INTEGER END AS priority, 'c' || c_custkey AS url FROM customer),
b AS (SELECT k FROM n WHERE level = 5 ORDER BY priority DESC, url LIMIT 19)
SELECT url, level AS depth, priority, level AS round FROM n WHERE level <= 5 OR (level = 6 AND (k - 1) // 2 IN (SELECT k FROM b))""")
def crawl_limited(spark, d):
    """A tree of customers, of which fifty are crawled; a limit needs no batch."""
    k = F.col("c_custkey")
    edges = table(spark, d, "customer").filter("c_custkey > 0").select(_s("c", F.floor((k - 1) / 2).cast("long")).alias("src"), _s("c", k).alias("dst"), F.lit("link").alias("kind"), (k % 12).cast("int").alias("score"))
    seeds = table(spark, d, "customer").filter("c_custkey = 0").select(_s("c", k).alias("url"))
    return frontier.crawl(seeds, edges, max_depth=100, limit=50)


@query("""WITH s AS (SELECT s_suppkey AS p, 'https://x' || s_suppkey || '.org' AS r FROM supplier),
v AS (SELECT p, r || '/exhibitor/list/a' AS url, 8::BIGINT AS score, 0 AS o FROM s UNION ALL SELECT p, r || '/exhibitor/list/b', CASE WHEN p % 2 = 0 THEN 18 ELSE 13 END, CASE WHEN p % 2 = 0 THEN -1 ELSE 1 END FROM s UNION ALL SELECT p, r || '/only/map', 8, -1 FROM s WHERE p % 2 = 0)
SELECT p AS page_id, url, score, row_number() OVER (PARTITION BY p ORDER BY score DESC, o, url)::INTEGER AS rank FROM v""")
def vendor_urls_with_sitemap(spark, d):
    k = F.col("s_suppkey")
    html = F.lit('<a href="/exhibitor/list/a">a</a><a href="/exhibitor/list/b">b</a><a href="/exhibitor/list/b">again</a><a href="/x/y">c</a>')
    pages = table(spark, d, "supplier").select(k.alias("page_id"), _s("https://x", k, ".org/").alias("url"), html.alias("html"))
    entries = F.explode(F.array(_s("https://x", k, ".org/exhibitor/list/b"), _s("https://x", k, ".org/only/map"), _s("https://x", k, ".org/only/map"))).alias("url")
    sitemap = table(spark, d, "supplier").filter(k % 2 == 0).select(k.alias("page_id"), entries)
    return links.vendor_urls(pages, sitemap, words=["exhib"], navigation=["nope"])
