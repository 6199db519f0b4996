"""Queries of sinks and saved files: what is written from a table is read back and returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dictionaries as D
from . import plans, sinks
from .catalog import _values, drawn
from .catalog_more import _choice, _pick, _s
from .operators import extract, frontier, links, report
from .registry import query
from .sources import snapshot
from .sources.snapshot import table


def _folder(spark, name: str) -> str:
    return f"{frontier.scratch(spark)}/{name}-{uuid.uuid4().hex}"


_SHEET = ["name", "website", "email", "country", "event_name", "confidence_score"]


@query(f"SELECT {', '.join(f'nullif({f}::VARCHAR, {chr(39) * 2}) AS {f}' for f in _SHEET)}, 'x' || (ord % 4) AS company_size FROM {_values('vendors_f')}")
def csv_written(spark, d):
    """The sheet with an extra field, as CSV with the export's headers."""
    path = _folder(spark, "csv")
    rows = drawn(spark, d, "vendors_f").withColumn("extras", F.create_map(F.lit("company_size"), _s("x", F.col("ord") % 4)))
    sinks.write_csv(rows, path)
    headers = dict(D.EXPORT_FIELDS) | {"company_size": "Company Size"}
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.nullif(F.col(f"`{headers[f]}`"), F.lit("")).alias(f) for f in (*_SHEET, "company_size")])


@query(f"""WITH v AS (SELECT * FROM {_values('vendors_f')})
SELECT 'total' AS metric, count(*)::VARCHAR AS value FROM v UNION ALL {' UNION ALL '.join(f"SELECT '{w}', count_if(contains(extraction_method, '{w}'))::VARCHAR FROM v" for w in ('pdf', 'schema_org', 'rule_based', 'llm'))}
UNION ALL {' UNION ALL '.join(f"SELECT 'with_{f}', count_if({f} <> '') || ' (' || (count_if({f} <> '') * 100 // count(*)) || '%)' FROM v" for f in ('country', 'website', 'email', 'phone', 'description', 'linkedin', 'event_name'))}""")
def report_written(spark, d):
    path = _folder(spark, "report")
    sinks.write_report(drawn(spark, d, "vendors_f"), path)
    return spark.read.parquet(f"{path}/statistics")


@query(f"""WITH v AS (SELECT * FROM {_values('vendors_f')} WHERE name <> '')
SELECT ord, name, email, NULL AS city FROM v WHERE ord % 2 = 0 UNION ALL SELECT ord, name, NULL, city FROM v WHERE ord % 3 = 0""")
def registry_bag(spark, d):
    """Two registrations of rows with different fields: named rows, as often as they were registered."""
    bag = sinks.Registry(spark, _folder(spark, "registry"))
    rows = drawn(spark, d, "vendors_f")
    bag.register(rows.filter("ord % 2 = 0").select("ord", "name", "email"))
    bag.register(rows.filter("ord % 3 = 0").select("ord", "name", "city"))
    return bag.rows().select("ord", "name", "email", "city")


@query("SELECT 'https://e.org/' || c_custkey AS url, 's' || (c_custkey % 3) AS session_id, c_mktsegment AS status, (c_custkey % 9)::INTEGER AS vendors_found FROM customer WHERE c_custkey % 3 <> 1")
def progress_written(spark, d):
    """Progress by session; one session is cleared."""
    path = _folder(spark, "progress")
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(_s("https://e.org/", k).alias("url"), _s("s", k % 3).alias("session_id"), F.col("c_mktsegment").alias("status"), (k % 9).cast("int").alias("vendors_found"))
    sinks.write_progress(rows, path)
    sinks.cleared_sessions(spark, path, "s1")
    return snapshot.progress(spark, path).select("url", "session_id", "status", "vendors_found")


@query("SELECT DISTINCT 'p' || o_custkey AS pattern FROM orders WHERE o_custkey % 4 > 0")
def blocklist_read(spark, d):
    """Saved blocklists, one file a status, with repeats and blanks."""
    path = _folder(spark, "blocklists")
    k = F.col("o_custkey")
    lists = table(spark, d, "orders").select(F.array(F.when(k % 4 > 0, _s("p", k)).otherwise(""), F.lit("")).alias("blocked_path_patterns"), F.col("o_orderkey").alias("n"))
    lists.groupBy((F.col("n") % 50).alias("file")).agg(F.flatten(F.collect_list("blocked_path_patterns")).alias("blocked_path_patterns")).repartition("file").drop("file").write.option("maxRecordsPerFile", 1).json(path)
    return snapshot.blocklist(spark, path)


@query("""WITH m AS (SELECT 'u' || (doc_id % 40) AS url, text AS markdown FROM documents WHERE trim(coalesce(text, '')) <> '' AND doc_id % 40 <> 7)
SELECT url, md5(arg_max(markdown, (length(markdown), markdown))) AS digest FROM m GROUP BY url""")
def markdown_longest(spark, d):
    """Texts of readers, several for each URL: the longest."""
    path = _folder(spark, "markdown")
    k = F.col("doc_id") % 40
    table(spark, d, "documents").select(F.when(k != 7, _s("u", k)).alias("url"), F.col("text").alias("markdown")).write.json(path)
    return snapshot.markdown(spark, path).select("url", F.md5("markdown").alias("digest"))


@query(f"""WITH h AS (SELECT {_pick('c_custkey', [t.replace('{query}', 'drone') for t in D.SEARCH_TEMPLATES[:7]])} AS q, c_custkey % 7 AS t, c_custkey AS k FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY k) AS n FROM h WHERE t < 6)
SELECT 'https://s' || k || '.org/x' AS url, 0 AS score FROM n WHERE n <= 15 ORDER BY t * 1000 + n LIMIT 40""")
def fallback_discovery(spark, d):
    """Seeds from the first six templates, fifteen hits each, forty in all."""
    searches = [t.replace("{query}", "drone") for t in D.SEARCH_TEMPLATES[:7]]
    k = F.col("c_custkey")
    hits = table(spark, d, "customer").select(_choice("c_custkey", searches).alias("query"), k.alias("ord"), F.lit("a page").alias("title"), _s("https://s", k, ".org/x").alias("url"), F.lit("").alias("snippet"))
    return snapshot.fallback_results(hits, "drone").select("url", "score")


_PLACES = [(label, engine) for label, engine, _ in D.REGIONS]


@query(f"""WITH h AS (SELECT c_custkey AS k, {_pick('c_custkey', [label for label, _ in _PLACES] + [D.GLOBAL_REGION[0]])} AS region, {_pick('c_custkey', [e for _, e in _PLACES] + [D.GLOBAL_REGION[1]])} AS engine, c_custkey % 5 AS t FROM customer),
a AS (SELECT DISTINCT label, engine FROM (VALUES {', '.join("('{}', '{}')".format(label, engine) for label, engine, words in D.REGIONS if any(w in "drone fairs in japan and germany" for w in words))}, ('{D.GLOBAL_REGION[0]}', '{D.GLOBAL_REGION[1]}')) AS v(label, engine))
SELECT 'https://s' || k || '.org/x' AS url, 0 AS score FROM h JOIN a ON h.region = a.label AND h.engine = a.engine WHERE t < 3""")
def seed_discovery_regions(spark, d):
    """Discovery by the regions a query names: hits of those regions, their engines and the templates count."""
    k = F.col("c_custkey")
    place = lambda values: _choice("c_custkey", values)
    asked = "drone fairs in Japan and Germany"
    searches = [t.replace("{query}", asked) for t in D.SEARCH_TEMPLATES]
    text = F.when(k % 5 < 3, F.get(F.array(*[F.lit(s) for s in searches[:3]]), (k % 5).cast("int"))).otherwise("another search")
    hits = table(spark, d, "customer").select(
        text.alias("query"), place([label for label, _ in _PLACES] + [D.GLOBAL_REGION[0]]).alias("region"), place([e for _, e in _PLACES] + [D.GLOBAL_REGION[1]]).alias("engine"), k.alias("ord"), F.lit("a page").alias("title"),
        _s("https://s", k, ".org/x").alias("url"), F.lit("").alias("snippet"),
    )
    return plans.discovered(asked, hits, D.region_table(spark), most=1 << 30).select("url", "score")


@query(f"SELECT ord, coalesce(nullif(event_name, ''), 'none') AS event_name, 'kept' AS state FROM {_values('vendors_f')}")
def partial_export(spark, d):
    """A run that fails: what there was is exported before the error goes on, and read back."""
    path = _folder(spark, "partial")
    rows = drawn(spark, d, "vendors_f")

    def failing(_: DataFrame) -> DataFrame:
        raise ArithmeticError("the run has failed")

    try:
        sinks.partial_exports(rows.withColumn("number", F.col("ord").cast("string")), path, failing)
    except ArithmeticError:
        pass
    back = spark.read.schema("number string, event_name string").json(f"{path}/partial")
    return back.select(F.col("number").cast("long").alias("ord"), F.coalesce("event_name", F.lit("none")).alias("event_name"), F.lit("kept").alias("state"))


@query("""SELECT page_id, count(*) AS n, count_if(external) AS externals FROM (SELECT c_custkey AS page_id, unnest([false, true, false, true]) AS external FROM customer) GROUP BY 1""")
def external_links(spark, d):
    """Links to the page's own registered domain, its subdomains, and others."""
    k = F.col("c_custkey")
    html = F.concat(F.lit('<a href="/a">a</a><a href="https://other'), k.cast("string"), F.lit('.com/">b</a><a href="https://shop.firm'), k.cast("string"), F.lit('.co.uk/c">c</a><a href="https://firm.co.uk/d">d</a>'))
    pages = snapshot.spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.alias("page_id"), _s("https://www.firm", k, ".co.uk/x").alias("url"), html.alias("html"))
    return links.links(pages).groupBy("page_id").agg(F.count("*").alias("n"), F.count_if("is_external").alias("externals"))


@query("SELECT count(*) AS rows, count_if(o_orderstatus = 'F') AS errors FROM orders")
def observed_counters(spark, d):
    """Counters of an action, had while it runs."""
    rows, counters = report.observed(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "error").otherwise("done").alias("status")))
    rows.write.format("noop").mode("overwrite").save()
    told = counters.get
    return spark.createDataFrame([(told["rows"], told["errors"])], "rows long, errors long")


@query("""SELECT s_suppkey AS page_id, CASE s_suppkey % 5 WHEN 0 THEN 'https://e.org/list/2' ELSE '' END AS next_url, s_suppkey % 5 IN (1, 2, 3) AS needs_click,
 CASE s_suppkey % 5 WHEN 1 THEN '#more' || s_suppkey WHEN 2 THEN '.pager.page-next' WHEN 3 THEN 'button' ELSE '' END AS selector FROM supplier""")
def next_page_steps(spark, d):
    """Pages that lead on by a link, a button with an id, a marked element, a bare button, or not at all."""
    k = F.col("s_suppkey")
    more = F.when(k % 5 == 0, F.lit('<span class="nextgen-banner-of-words">' + "words " * 20 + '</span><a href="#">Next</a><a href="/list/2" rel="nofollow next">2</a>'))
    more = more.when(k % 5 == 1, _s('<button id="more', k, '" class="b">Next page</button>')).when(k % 5 == 2, F.lit('<li class="pager page-next"><i></i></li>'))
    more = more.when(k % 5 == 3, F.lit("<button>»</button>")).otherwise(F.lit("<p>The nextdoor shop</p><div>What comes after</div>"))
    pages = table(spark, d, "supplier").select(k.alias("page_id"), F.when(k % 5 == 0, "https://e.org/list").otherwise("https://e.org/x").alias("url"), F.concat(F.lit("<body>"), more, F.lit("</body>")).alias("html"))
    return extract.next_steps(pages)


@query("""SELECT s_suppkey AS page_id, s_name AS name, NULL AS country, 'https://expo.org/' || s_suppkey AS source_url FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT NULL, 'Firm ' || c_custkey || '-' || i, CASE WHEN i = 2 THEN 'Japan' ELSE 'France' END, 'https://e.org/' || c_custkey || '.pdf' FROM customer, unnest(range(1, 4)) AS u(i) WHERE c_custkey % 3 = 0""")
def extraction_with_documents(spark, d):
    """Pages and PDF lists in one extraction; other documents are left out."""
    k = F.col("c_custkey")
    listed = F.concat(F.lit("| COMPANY | COUNTRY |\n|---|---|"), *[_s("\n| Firm ", k, f"-{i} | {'JAPAN' if i == 2 else 'FRANCE'} |") for i in (1, 2, 3)])
    docs = table(spark, d, "customer").select(_s("https://e.org/", k, F.when(k % 3 == 0, ".pdf").otherwise(".html")).alias("url"), listed.alias("markdown"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    pages = s.select(F.col("s_suppkey").alias("page_id"), _s("https://expo.org/", F.col("s_suppkey")).alias("url"), F.concat(F.lit('<body><h1 class="company">'), "s_name", F.lit("</h1><p>A firm of some kind that makes what its clients ask for, and has done so for many years.</p></body>")).alias("html"))
    return plans.extraction(pages, documents=docs).select("page_id", "name", "country", "source_url")
