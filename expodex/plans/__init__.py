"""The prescribed order of operators: pages to records, records to a clean directory.

Null ids and repeated rows pass through every plan as rows of their own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import scoring
from ..functions import text as X
from ..functions import urls as U
from ..operators import extract, hooks, links, pdf, records, relational
from ..sources import snapshot


def page_records(pages: DataFrame, enough: int = 3, translate: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """page_id, source_url, text, fields, extras, extraction_method of every page that says anything.

    A schema.org record of at least `enough` core fields stands alone; a poorer one is merged with the
    rule-based record, field by field: the first value of more than one character, then any.
    """
    rows = extract.both_records(pages, translate)
    s, r = F.col("schema"), F.col("rules")
    core = [f for f in D.CORE_FIELDS if f != "category"]
    n_s, n_r = X.populated([s[f] for f in core]), X.populated([r[f] for f in D.CORE_FIELDS])
    rows = relational.computed(rows, n_s=n_s, n_r=n_r).filter("n_s > 0 or n_r > 0").withColumnRenamed("url", "source_url")
    rows = relational.computed(rows, alone=F.expr(f"n_s >= {enough} or n_r = 0"), both=F.expr(f"n_s > 0 and n_s < {enough} and n_r > 0")).drop("n_s", "n_r")
    alone, both = F.col("alone"), F.col("both")

    def field(f: str) -> Column:
        a, b = (s[f] if f in core else F.lit(None).cast("string")), r[f]
        good = lambda c: F.when(F.length(F.trim(c)) > 1, F.trim(c))
        return F.when(alone, a).when(both, F.coalesce(good(a), good(b), X.missing(a), X.missing(b))).otherwise(b).alias(f)

    method = F.when(alone, "schema_org").when(both, "schema_org+rule_based").otherwise("rule_based")
    extras = F.when(alone, F.create_map().cast("map<string,string>")).otherwise(r["extras"])
    own = {f: field(f) for f in extract.RECORD} | {"extras": extras, "extraction_method": method}
    return relational.computed(rows, **own).drop("schema", "rules", "alone", "both")


def extraction(
    pages: DataFrame, enough: int = 3, context: dict[str, str] | None = None, documents: DataFrame | None = None, model: hooks.Model | None = None, translate: Callable[[Column], Column] = lambda c: c
) -> DataFrame:
    """Cheap before costly, one parse a page: schema.org, rules, then `model` for pages that still say less than `enough`.

    documents: (url, markdown) of PDF files, which take the way of operators.pdf instead.
    """
    rows = page_records(pages, enough, translate)
    if model is not None:
        rows = hooks.completed(rows, model, enough)
    rows = rows.drop("text").withColumn("ord", F.col("page_id"))
    if documents is not None:
        listed = pdf.vendors(documents.filter(U.is_pdf(F.col("url")))).drop("confidence_score")
        rows = rows.unionByName(listed.withColumn("page_id", F.lit(None).cast("long")).withColumn("ord", F.col("ord").cast("long")), allowMissingColumns=True)
    return records.validated(relational.context_filled(rows, context or {}))


def directory(vendors: DataFrame, found: DataFrame | None = None, second: DataFrame | None = None) -> DataFrame:
    """Enrich what needs it, then once more from `second` what still lacks two of five fields; deduplicate; best first."""
    if found is not None:
        need = F.coalesce(records.lacking() >= 3, F.lit(False))
        vendors = records.enriched(vendors, found, "ord", only=need)
    if second is not None:
        vendors = records.websearch_filled(vendors, second, "ord", only=records.lacking(["website", "email", "phone", "description", "country"]) >= 2)
    out = records.deduplicated(records.with_confidence(vendors))
    return out.orderBy(F.desc("confidence_score"), "ord")


def seeds(results: DataFrame, regions: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Search hits scored, deduplicated and cut to the best.

    regions: (label, engine) that a query asked for; hits of other regions are left out. Without a limit
    of its own a search keeps 40 for one region, 100 for up to three, 200 beyond.
    """
    n = None
    if regions is not None:
        n = regions.select("label").distinct().count()
        results = results.join(F.broadcast(regions.select(F.col("label").alias("region")).distinct()), "region", "left_semi")
    limit = most if most is not None else 40 if n is None or n <= 1 else 100 if n <= 3 else 200
    rows = results.withColumn("score", scoring.seed_score(F.col("url"), F.col("title"), F.col("snippet")))
    return records.deduplicated_seeds(rows).orderBy(F.desc("score"), "ord").limit(limit)


def discovered(query: str, results: DataFrame, regions: DataFrame, most: int | None = None) -> DataFrame:
    """Seed discovery: regions of the query, one search a region and template, hits of those searches, the best of them.

    results: saved hits (query, engine, region, ord, title, url, snippet); regions: the table of
    dictionaries.region_table().
    """
    spark = results.sparkSession
    asked = relational.detected_regions(spark.createDataFrame([(1, query)], "ord int, query string"), regions).select("label", "engine").distinct()
    searches = relational.search_queries(query, asked, D.SEARCH_TEMPLATES).select(F.col("label").alias("region"), "engine", "query")
    hits = results.join(F.broadcast(searches.distinct()), ["region", "engine", "query"], "left_semi")
    return seeds(hits, asked, most)


def domain_enriched(vendors: DataFrame, pages: DataFrame) -> DataFrame:
    """vendors (with `ord`) filled from the pages of their own registered domains (page_id, url, html), one parse a page.

    A domain is the vendor's own unless the page it was found on has it too or it belongs to a host that many share
    (SKIP_DOMAINS). Of several pages of a domain that with the least page_id is taken; the vendor's own values stay first.
    """
    domain = lambda url: U.registered_domain(U.bare_host(F.coalesce(url, F.lit(""))))
    home = pages.withColumn("__host", domain(F.col("url"))).filter("__host <> ''")
    source = domain(F.col("source_url")) if "source_url" in vendors.columns else F.lit("")
    owners = records.without_skipped(vendors.filter(records.own_domain(vendors).isNotNull()), "website")
    wanted = owners.select(domain(F.col("website")).alias("__host"), source.alias("__source"), "ord").filter("__host <> '' and __host <> __source").drop("__source")
    home = home.join(wanted.select("__host").distinct(), "__host", "left_semi").groupBy("__host").agg(F.min_by(F.struct("page_id", "url", "html"), F.struct("page_id", "url")).alias("p")).select("p.*")
    found = page_records(home).withColumn("__host", domain(F.col("source_url"))).drop("page_id", "text", "extras", "source_url", "extraction_method", "name", "organizer")
    found = found.join(wanted, "__host").drop("__host")
    return records.websearch_filled(vendors, found, "ord", mark="+enrichment")


_FIVE = ["website", "email", "phone", "description", "country"]


def context_enriched(vendors: DataFrame, hits: DataFrame, model: hooks.Model | None, least: int = 2) -> DataFrame:
    """vendors (with `ord` and name) that lack `least` of five fields, filled from what searches found of them.

    hits: (vendor, ord, title, url, snippet), vendor being a vendor's `ord`. The snippets are put to the model, whose JSON fills
    gaps; a website that it does not name is the best URL of the hits. Without a model, that alone is filled.
    """
    poor = F.coalesce(records.lacking(_FIVE) >= least, F.lit(True))
    asked = vendors.filter(poor & X.missing(F.col("name")).isNotNull()).select("ord", "name")
    context = snapshot.search_context(hits, "vendor").withColumnRenamed("vendor", "ord")
    rows = asked.join(context, "ord")
    prompt = F.concat_ws("\n", F.concat(F.lit("Company: "), "name"), "context")
    said = hooks.answers(rows.select(F.col("ord").alias("id"), prompt.alias("text")), model)
    told = said.select(F.col("id").alias("ord"), hooks.json_fields(F.col("answer")).alias("f"))
    found = rows.select("ord", "best_url").join(told, "ord", "left")
    fields = [f for f in D.MERGE_FIELDS if f in vendors.columns and f not in ("name", "source_url", "extraction_method")]
    value = {f: F.try_element_at("f", F.lit(f)) for f in fields} | {"website": F.coalesce(X.missing(F.try_element_at("f", F.lit("website"))), F.col("best_url"))}
    return records.websearch_filled(vendors, found.select("ord", *[value[f].alias(f) for f in fields]), "ord", only=poor)


def crawl_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, kind, score) for operators.frontier.crawl."""
    scored = links.links(pages)
    kind = F.when(F.col("url").rlike(r"(?i)/page/\d+|[?&]page=\d+"), "page").when(F.col("score") >= 8, "list").otherwise("link")
    return scored.select(F.col("base").alias("src"), F.col("url").alias("dst"), kind.alias("kind"), "score").distinct()
