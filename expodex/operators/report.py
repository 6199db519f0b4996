"""Reporting aggregates over a vendor table and over runs.

NULL and blank values count as missing; repeated rows count as often as they occur; an empty table gives
one row of zeros, or no rows where values are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X


def method_buckets(df: DataFrame) -> DataFrame:
    """One row: vendors, and how many methods hold each word (buckets overlap)."""
    has = lambda w: F.count_if(F.coalesce("extraction_method", F.lit("")).contains(w))
    return df.agg(F.count("*").alias("total"), *[has(w).alias(w) for w in ("pdf", "schema_org", "rule_based", "llm")])


def fill_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, filled, percent (floor)."""
    sums = df.agg(F.count("*").alias("n"), *[F.count_if(X.missing(F.col(f)).isNotNull()).alias(f) for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled"), F.expr(f"`{f}` * 100 div greatest(n, 1)").alias("percent")) for f in fields])).alias("x")
    return sums.select(each).select("x.*")


def distinct_values(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct(X.missing(F.col("country"))).alias("countries"), F.count_distinct(X.missing(F.col("event_name"))).alias("events"))


def top_values(df: DataFrame, field: str, most: int = 15) -> DataFrame:
    """Values by count, the first seen of equals first; missing ones count as Unknown."""
    rows = df.withColumn("value", F.coalesce(X.missing(F.col(field)), F.lit("Unknown")))
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord")).orderBy(F.desc("n"), "first_ord").limit(most)


def dynamic_columns(df: DataFrame) -> DataFrame:
    """field, header, n of the extra fields by how many rows fill them, the first seen of equals first."""
    fixed = [f for f, _ in D.EXPORT_FIELDS]
    rows = df.select("ord", F.explode("extras").alias("field", "value")).filter(~F.col("field").isin(fixed)).filter(X.missing(F.col("value")).isNotNull())
    out = rows.groupBy("field").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    return out.select("field", F.initcap(F.replace("field", F.lit("_"), F.lit(" "))).alias("header"), "n", "first_ord").orderBy(F.desc("n"), "first_ord", "field")


def region_counts(top: DataFrame) -> DataFrame:
    """label, n of the chosen seeds; those without a region count as Global."""
    return top.groupBy(F.coalesce("region", F.lit("Global")).alias("label")).agg(F.count("*").alias("n"))


def listing_ranks(df: DataFrame) -> DataFrame:
    """Listings by the product of their own and the engine's score, best first."""
    return df.withColumn("product", F.col("listing_score") * F.col("score")).orderBy(F.desc("product"), "ord")


def share_filled(fields: list[Column]) -> Column:
    """Share of filled fields, rounded to two places."""
    return F.round(X.populated(fields) / F.lit(float(len(fields))), 2)


def run_stats(runs: DataFrame) -> DataFrame:
    """One row of sums with success rate, share and cost of model calls, and requests a second."""
    sums = runs.agg(*[F.sum(c).alias(c) for c in ("crawled", "failed", "schema_org", "rule_based", "llm", "tokens_in", "tokens_out")], F.max("elapsed").alias("elapsed"))
    made = F.col("schema_org") + F.col("rule_based") + F.col("llm")
    tried = F.col("crawled") + F.col("failed")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(
        "*",
        zero(F.try_divide(F.col("llm") * 100.0, made)).alias("llm_percentage"),
        zero(F.try_divide(F.col("crawled") * 100.0, tried)).alias("success_rate"),
        (F.col("tokens_in") * 0.15 / 1e6 + F.col("tokens_out") * 0.60 / 1e6).alias("cost_usd"),
        zero(F.try_divide(F.col("crawled").cast("double"), F.col("elapsed"))).alias("requests_per_second"),
    )


def pool_status(progress: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("status") == s)
    return progress.agg(F.count("*").alias("workers"), is_("done").alias("done"), is_("error").alias("failed"), is_("running").alias("running"), F.coalesce(F.sum("vendors_found"), F.lit(0)).alias("vendors"))


def statistics(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """metric, value: the report sheet as rows."""
    fields = fields or [f for f in ("country", "website", "email", "phone", "description", "linkedin", "booth_number", "event_name") if f in df.columns]
    buckets = method_buckets(df).select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("string").alias("value")) for k in ("total", "pdf", "schema_org", "rule_based", "llm")])).alias("x")).select("x.*")
    rates = fill_rates(df, fields).select(F.concat(F.lit("with_"), "field").alias("metric"), F.concat("filled", F.lit(" ("), "percent", F.lit("%)")).alias("value"))
    return buckets.unionByName(rates)


def run_metrics(listings: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row: listings, links and profile URLs of them, vendors, those with a name, those of confidence 0.5 and more, mean of filled fields (one place)."""
    a = listings.agg(F.count("*").alias("listings"), F.coalesce(F.sum("links_found"), F.lit(0)).alias("links"), F.coalesce(F.sum(F.size("vendor_urls")), F.lit(0)).alias("profile_urls"))
    b = vendors.agg(
        F.count("*").alias("vendors"), F.count(X.missing(F.col("name"))).alias("named"), F.count_if(F.coalesce("confidence", F.lit(0.0)) >= 0.5).alias("confident"),
        F.coalesce(F.round(F.avg("fields_filled"), 1), F.lit(0.0)).alias("mean_fields"),
    )
    return a.join(b)  # one row each


def observed(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """df with counters of rows and errors that fill while an action runs; the Observation gives them afterwards."""
    counters = Observation(name)
    failed = F.count_if(F.col("status") == "error") if "status" in df.columns else F.lit(0).cast("long") * F.count("*")
    return df.observe(counters, F.count("*").alias("rows"), failed.alias("errors")), counters
