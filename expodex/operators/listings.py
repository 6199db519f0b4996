"""Listings by a model: a long page in overlapping pieces, asked about in batches, the answers put together again.

A piece is so many words with the blanks between them; the next one begins before the last has ended, so a company at a
seam stands whole in one of them. What neighbouring pieces say of one company is one record; a name that comes back in pieces that
do not touch is another. The model is handed in (operators.hooks); nothing is asked without one.

Defined results: null and blank texts have no pieces; a text of at most one piece is asked about once; answers that are no
JSON, or say that the page lists nothing, give no rows; entries without a name are left out; a page that is repeated, id, URL
and text, is read once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .hooks import Model, answers
from .records import normalized_extras, with_confidence

#: The least text worth asking about, and characters of a value that are kept.
LEAST_TEXT, LONGEST = 200, 2000
# End of fixed values.
WORDS, OVERLAP = 800, 80
_ANSWER = "is_vendor_listing boolean, vendors array<map<string,string>>"


def pieces(pages: DataFrame, words: int = WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(row, text) -> row, piece (from 0), text: runs of `words` words, each beginning `overlap` words before the last one ends."""
    if not 0 <= overlap < words:
        raise ValueError("pieces must be longer than what they share")
    step = words - overlap
    cut = pages.withColumn("__words", F.regexp_extract_all(F.regexp_replace("text", r"^\s+", ""), F.lit(r"\S+\s*"), F.lit(0))).filter("size(__words) > 0")
    last = F.floor(F.greatest(F.size("__words") - words + step - 1, F.lit(0)) / step).cast("int")
    return cut.select("row", "__words", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select("row", "piece", F.array_join(F.slice("__words", F.col("piece") * step + 1, F.lit(words)), "").alias("text"))


def _json(text: Column) -> Column:
    """The answer's object: the text as it is, or what stands from its first brace to its last."""
    whole = F.from_json(text, _ANSWER)
    return F.coalesce(F.when(whole["is_vendor_listing"].isNotNull() | whole["vendors"].isNotNull(), whole), F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), _ANSWER))


def reconciled(entries: DataFrame, fields: Column | None = None) -> DataFrame:
    """(row, piece, ord, key, fields map) -> row, piece, ord, key, fields: entries of one key in pieces that follow each other are one.

    Of every field the first value counts, in the order of pieces and entries. Entries of one key within a piece are one as well.
    """
    own = Window.partitionBy("row", "key").orderBy("piece")
    same = F.max("piece").over(own.rangeBetween(Window.unboundedPreceding, -1))
    rows = entries.withColumn("starts", F.when(F.col("piece") - same > 1, 1).otherwise(0))
    # The pieces a name stands in are those of one page: few, and sorted by Spark.
    rows = rows.withColumn("island", F.sum("starts").over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    each = rows.select("row", "key", "island", "piece", "ord", F.explode_outer("fields").alias("field", "value"))
    by = F.struct("piece", "ord")
    values = each.groupBy("row", "key", "island", "field").agg(F.min_by("value", by).alias("value"), F.min(by).alias("at"))
    pairs = F.map_from_entries(F.collect_list(F.struct("field", "value")))  # the distinct fields of one company
    return values.filter("field is not null").groupBy("row", "key", "island").agg(pairs.alias("fields"), F.min("at").alias("at")).select("row", "at.piece", "at.ord", "key", "fields")


def listed(pages: DataFrame, model: Model | None, words: int = WORDS, overlap: int = OVERLAP, least: int = LEAST_TEXT, batch: int = 64) -> DataFrame:
    """(page_id, url, text) -> page_id, source_url, ord, name, fields: the companies of every page that lists some, in its order.

    Texts of less than `least` characters are not asked about.
    """
    numbered = pages.select("page_id", "url", "text").withColumn("row", F.struct("page_id", "url", F.xxhash64("text").alias("h")))
    asked = pieces(numbered.filter(F.length("text") >= least).select("row", "text"), words, overlap)
    asked = asked.groupBy("row", "piece").agg(F.first("text").alias("text")).withColumn("id", F.xxhash64("row", "piece"))
    said = answers(asked.select("id", "text"), model, batch).select("id", _json(F.col("answer")).alias("a"))
    entries = asked.select("id", "row", "piece").join(said, "id").filter("a.is_vendor_listing").select("row", "piece", F.posexplode("a.vendors").alias("ord", "fields"))
    entries = entries.withColumn("fields", F.transform_values(normalized_extras(F.col("fields")), lambda k, v: F.left(F.trim(v), F.lit(LONGEST))))
    entries = entries.withColumn("name", X.missing(F.try_element_at("fields", F.lit("name")))).filter("name is not null").withColumn("key", X.company_key(F.col("name")))
    found = reconciled(entries.filter("key <> ''").drop("name"))
    own = numbered.select("page_id", "url", "row").distinct()
    place = F.col("piece").cast("long") * 100_000 + F.col("ord")
    return found.join(own, "row").select("page_id", F.col("url").alias("source_url"), place.alias("ord"), F.col("fields")["name"].alias("name"), "fields")


def vendors(rows: DataFrame, context: dict[str, str] | None = None) -> DataFrame:
    """listed() rows as records: the core fields as columns, the others in `extras`, gaps filled from the context, with confidence."""
    core = ["website", "email", "phone", "address", "city", "country", "description", "category", "linkedin"]
    filled = F.map_concat(F.create_map(*[F.lit(x) for kv in (context or {}).items() for x in kv]).cast("map<string,string>"), F.create_map().cast("map<string,string>"))
    value = lambda f: F.coalesce(F.try_element_at("fields", F.lit(f)), F.try_element_at(filled, F.lit(f)))
    extras = F.map_filter("fields", lambda k, v: ~k.isin("name", *core))
    out = rows.select("page_id", "source_url", "ord", "name", *[value(f).alias(f) for f in core], value("event_name").alias("event_name"), extras.alias("extras"), F.lit("listing_llm").alias("extraction_method"))
    return with_confidence(out)
