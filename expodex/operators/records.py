"""Vendor records: validation, source merging, keyed deduplication with back-fill, enrichment merge.

A record's fields are string columns; NULL and blank both mean missing. `ord` gives the input order
on which "first wins" rests; further fields travel in the map column `extras`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X
from ..functions import urls as U
from .links import first_by
from .relational import computed


def _has(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def with_confidence(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence_score", X.confidence({k: _has(df, k) for k in D.CORE_FIELDS}))


def validated(df: DataFrame, translate: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Records with a plausible name; implausible fields become NULL, the rest is normalised.

    translate: what names in Chinese or Cyrillic script go through before they are judged.
    """
    rules = {
        "name": lambda c: X.valid_name(c, translate), "email": X.valid_email, "website": X.valid_website, "phone": X.valid_phone, "country": X.valid_country,
        "description": X.valid_description, **dict.fromkeys(("city", "address", "category", "booth_number", "event_name"), X.clean),
    }
    held = [f for f in rules if f in df.columns]
    out = computed(computed(df, **{f: X.missing(F.col(f)) for f in held}), **{f: rules[f](F.col(f)) for f in held}).filter("name is not null")
    return with_confidence(out).withColumn("is_valid", F.lit(True))


def merged_sources(df: DataFrame, key: str, priority: dict[str, int] = D.METHOD_PRIORITY) -> DataFrame:
    """One record of each key from its sources: per field the first value of more than one character by
    method priority, then order. A single source is kept as it is."""
    rank = -F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("extraction_method")), F.lit(0))
    rows = df.withColumn("__by", F.struct(rank.alias("p"), F.col("ord").alias("o")))
    fields = [f for f in D.MERGE_FIELDS if f in df.columns]
    good = lambda f: F.length(F.trim(F.col(f))) > 1
    picked = [
        F.when(F.count("*") == 1, F.min_by(f, "__by")).otherwise(F.coalesce(F.min_by(F.when(good(f), F.trim(f)), F.when(good(f), F.col("__by"))), F.min_by(F.when(X.missing(F.col(f)).isNotNull(), F.col(f)), F.when(X.missing(F.col(f)).isNotNull(), F.col("__by"))))).alias(f)
        for f in fields
    ]
    methods = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(X.missing(F.col("extraction_method")).isNotNull(), F.struct("ord", "extraction_method")))), lambda m: m["extraction_method"]))
    # Sources of one entity are few (one for each extraction method), so this list is short.
    out = rows.groupBy(key).agg(*picked, F.coalesce(F.nullif(F.array_join(methods, "+"), F.lit("")), F.lit("unknown")).alias("extraction_method"), F.min_by("source_url", "__by").alias("source_url"))
    return with_confidence(out)


def dedup_key(df: DataFrame) -> DataFrame:
    """df with dedup_key: the vendor's own domain, else its name, else itself; events kept apart."""
    own, source = U.bare_host(F.coalesce(F.col("website"), F.lit("")), anywhere=True), U.bare_host(F.coalesce(F.col("source_url"), F.lit("")), anywhere=True)
    name = X.company_key(F.coalesce(F.col("name"), F.lit("")))
    event = F.left(F.trim(F.lower(F.coalesce(F.col("event_name"), F.lit("")))), F.lit(20))
    base = F.when((own != "") & (own != source), own).when(name != "", name).otherwise(F.concat(F.lit("__unnamed_"), F.col("ord").cast("string")))
    return df.withColumn("dedup_key", F.when(event != "", F.concat(base, F.lit("|"), event)).otherwise(base))


def deduplicated(df: DataFrame) -> DataFrame:
    """One record of each key: the first of highest confidence, its missing fields from the others in order.

    Ordered aggregates, not windows, so a key with many records is combined before the shuffle.
    """
    rows = dedup_key(df) if "dedup_key" not in df.columns else df
    score = F.coalesce("confidence_score", F.lit(0.0))
    fields = [f for f in df.columns if f not in ("ord", "confidence_score", "dedup_key")]
    rows = rows.withColumn("__best", F.struct((-score).alias("s"), F.col("ord").alias("o")))
    best = [F.min_by(f, "__best").alias(f"__b_{f}") for f in fields]
    fill = [F.min_by(f, F.when(X.missing(F.col(f)).isNotNull(), F.col("ord"))).alias(f"__f_{f}") for f in fields]
    out = rows.groupBy("dedup_key").agg(F.min_by("ord", "__best").alias("ord"), F.min_by("confidence_score", "__best").alias("confidence_score"), F.count("*").alias("merged"), *best, *fill)
    return out.select("dedup_key", "ord", *[F.coalesce(X.missing(F.col(f"__b_{f}")), F.col(f"__f_{f}")).alias(f) for f in fields], "confidence_score", "merged")


def duplicate_names(df: DataFrame, most: int = 100) -> DataFrame:
    """Names that occur more than once, with the website host and country of the first such record."""
    rows = df.filter(X.missing(F.col("name")).isNotNull()).withColumn("key", F.trim(F.lower("name")))
    found = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.min_by("website", "ord").alias("website"), F.min_by("country", "ord").alias("country"))
    found = found.filter("n > 1").select(F.left("key", F.lit(100)).alias("name"), U.host(F.col("website")).alias("domain"), F.coalesce("country", F.lit("")).alias("country"), "n", "first_ord")
    return found.orderBy(F.desc("n"), "first_ord").limit(most)


def deduplicated_seeds(df: DataFrame, least: int = 5) -> DataFrame:
    """(ord, url, score): the first of each URL; a domain's later URLs only from a score of `least`."""
    rows = df.filter(F.coalesce("url", F.lit("")) != "").withColumn("__key", F.lower(F.regexp_replace("url", "/+$", "")))
    rows = first_by(rows, ["__key"], F.col("ord")).withColumn("domain", U.host(F.col("url")))
    n = F.row_number().over(Window.partitionBy("domain").orderBy("ord"))
    return rows.withColumn("__n", n).filter(F.expr(f"__n = 1 or coalesce(score, 0) >= {least}")).drop("__n", "__key")


_SIX = ["website", "email", "phone", "description", "linkedin", "category"]


def lacking(fields: list[str] | None = None) -> Column:
    """How many of the fields are missing."""
    fields = fields or _SIX
    return F.lit(len(fields)) - X.populated([F.col(f) for f in fields])


def needs_enrichment(df: DataFrame, fields: list[str] | None = None, least: int = 3) -> DataFrame:
    return df.filter(lacking(fields) >= least)


def own_domain(df: DataFrame) -> Column:
    """The vendor's own host; NULL if it has none or shares it with the page it was found on."""
    own, source = U.bare_host(F.coalesce(_has(df, "website"), F.lit(""))), U.bare_host(F.coalesce(_has(df, "source_url"), F.lit("")))
    return F.when((own != "") & (own != source), own)


def needs_domain(df: DataFrame, most: int | None = None) -> DataFrame:
    """Vendors with a domain of their own that lack two of email, phone, description and country; the first `most` by ord."""
    rows = df.filter((lacking(["email", "phone", "description", "country"]) >= 2) & own_domain(df).isNotNull())
    return rows if most is None else rows.orderBy("ord").limit(most)


def without_skipped(df: DataFrame, column: str = "url", domains: list[str] = D.SKIP_DOMAINS) -> DataFrame:
    """Rows whose host holds none of the domains; a missing URL stays."""
    hit = U.host(F.col(column)).rlike("|".join(d.replace(".", r"\.") for d in domains))
    return df.filter(~F.coalesce(hit, F.lit(False)))


def confident(df: DataFrame, least: float = 0.10) -> DataFrame:
    """Rows of at least that confidence; a missing one counts as 0."""
    return df.filter(F.coalesce("confidence_score", F.lit(0.0)) >= least)


def first_values(found: DataFrame, key: str, fields: list[str], order: Column | None = None) -> DataFrame:
    """key and `__new`, a struct of the fields: of a key's rows the first value of each field that is not missing.

    order: which row comes first; by default that with fewest missing fields, then by the values themselves.
    """
    value = lambda f: X.missing(F.col(f))
    if order is None:
        order = F.struct(F.lit(len(fields)) - X.populated([F.col(f) for f in fields]), *[F.struct(value(f).isNull(), value(f)) for f in fields])
    picked = [F.min_by(f, F.when(value(f).isNotNull(), F.col("__order"))).alias(f) for f in fields]
    rows = found.select(key, *fields, order.alias("__order")).groupBy(key).agg(*picked)
    return rows.select(key, F.struct(*fields).alias("__new"))


def enriched(df: DataFrame, found: DataFrame, key: str, fields: list[str] = D.ENRICHABLE, blank_short: bool = False, only: Column | None = None, order: Column | None = None) -> DataFrame:
    """Left merge: empty fields filled from `found` (of several rows of a key, each field's first_values()), never overwritten.

    Existing and new values are cleaned first; blank_short=True also empties values that are shorter
    than three characters; rows outside `only` stay as they are.
    """
    both = [f for f in fields if f in found.columns and f in df.columns]
    only = F.lit(True) if only is None else only
    new = first_values(found, key, both, order) if both else found.select(key, F.lit(None).alias("__new")).distinct()
    out = df.withColumn("__only", only).join(new, key, "left")
    columns = []
    for f, kind in df.dtypes:
        if kind != "string" or f == key:
            columns.append(F.col(f))
            continue
        free = f in ("description", "category", "address")
        now = X.clean_field(F.col(f), free) if blank_short else F.when(F.length(F.trim(F.col(f))) < 3, F.col(f)).otherwise(X.clean_field(F.col(f), free))
        fill = F.left(X.clean_field(F.col("__new")[f], free), F.lit(500)) if f in both else F.lit(None)
        columns.append(F.when(F.col("__only"), F.coalesce(X.missing(now), fill)).otherwise(F.col(f)).alias(f))
    return out.select(*columns)


def websearch_filled(df: DataFrame, found: DataFrame, key: str, only: Column | None = None, mark: str = "+websearch", order: Column | None = None) -> DataFrame:
    """Any string field of `found` (of several rows of a key, each field's first_values()) fills an empty one; the method says so if anything was filled."""
    fields = [f for f in found.columns if f != key and f in df.columns and f != "extraction_method"]
    new = first_values(found, key, fields, order)
    out = df.withColumn("__only", F.lit(True) if only is None else only).join(new, key, "left")
    fill = {f: F.when(F.col("__only"), X.missing(F.col("__new")[f])) for f in fields}
    filled = F.lit(False)
    for f in fields:
        filled = filled | (X.missing(F.col(f)).isNull() & fill[f].isNotNull())
    method = F.when(filled, F.concat("extraction_method", F.lit(mark))).otherwise(F.col("extraction_method")).alias("extraction_method")
    return out.select(*[F.coalesce(X.missing(F.col(f)), fill[f]).alias(f) if f in fields else method if f == "extraction_method" else F.col(f) for f in df.columns])


def chinese_or_russian(df: DataFrame) -> Column:
    words = "|".join(w.replace(".", r"\.") for w in D.CHINA_WORDS + D.RUSSIA_WORDS)
    of = lambda f: F.lower(F.coalesce(_has(df, f), F.lit("")))
    tld = lambda f: U.host(of(f)).rlike(r"\.(cn|ru|su)$") | of(f).contains(".com.cn")
    name = F.coalesce(_has(df, "name"), F.lit(""))
    return tld("website") | tld("source_url") | F.concat_ws(" ", of("country"), of("name"), of("city"), of("address")).rlike(words) | name.rlike(r"[\x{4e00}-\x{9fff}\x{0400}-\x{04ff}]")


def normalized_extras(column: Column) -> Column:
    """Keys normalised, empty values dropped, the first of keys that become equal; NULL gives an empty map."""
    pairs = F.transform(F.filter(F.map_entries(column), lambda e: X.missing(e["value"]).isNotNull()), lambda e: F.struct(X.key_name(e["key"]).alias("key"), e["value"].alias("value")))
    first = F.filter(pairs, lambda p, k: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == k + 1)
    return F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>"))
