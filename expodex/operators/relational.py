"""The pipeline's joins and set operations, by name.

Null keys match nothing: such rows stay in left and anti joins. Repeated rows stay repeated unless an
operator says that it keeps one. Empty sides are allowed. Names that begin with `__` are the operators' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns (which replace others of the name), each computed once.

    What is built inside an array and exploded is neither repeated in filters above nor merged with
    projections above, so long chains of rules stay linear in size.
    """
    own = F.struct(*[c.alias(k) for k, c in columns.items()])
    order = [c for c in rows.columns if c not in columns]
    return rows.select(*order, F.explode(F.array(own)).alias("__own")).select(*order, "__own.*")


def not_visited(frontier: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    return frontier.join(visited.select(key), key, "left_anti")


def appended_if_new(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """held and the rows of `new` whose key it lacks; missing columns become NULL."""
    return held.unionByName(new.join(held.select(key), key, "left_anti"), allowMissingColumns=True)


def with_metadata(rows: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    return rows.join(metadata, key, "left")


def context_filled(rows: DataFrame, context: dict[str, str]) -> DataFrame:
    """Constants for the fields that are missing, never over values."""
    for name, value in context.items():
        now = X.missing(F.col(name)) if name in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn(name, F.coalesce(now, F.lit(value)))
    return rows


def detected_regions(queries: DataFrame, regions: DataFrame) -> DataFrame:
    """(ord, query) -> ord, label, engine: Global and every region with a keyword in the query; all of them
    for a query that asks for the whole world. regions: (ord, label, engine, keyword), a short fixed list."""
    low = F.lower(F.col("query"))
    every = F.broadcast(regions.agg(F.collect_list(F.struct("label", "engine", "keyword")).alias("__r")))
    rows = computed(queries.select("ord", "query").crossJoin(every), __low=low, __world=low.rlike("|".join(D.GLOBAL_KEYWORDS)))
    said = F.transform(F.filter("__r", lambda r: F.col("__world") | F.contains("__low", r["keyword"])), lambda r: F.struct(r["label"].alias("label"), r["engine"].alias("engine")))
    hits = rows.select("ord", F.explode(F.array_distinct(said)).alias("__h")).select("ord", "__h.*").distinct()
    return hits.unionByName(queries.select("ord", F.lit(D.GLOBAL_REGION[0]).alias("label"), F.lit(D.GLOBAL_REGION[1]).alias("engine")))


def search_queries(query: str, regions: DataFrame, templates: list[str]) -> DataFrame:
    """One search for each region and template (both short lists)."""
    each = F.posexplode(F.array(*[F.lit(t.replace("{query}", query)) for t in templates])).alias("template_ord", "query")
    return regions.select("*", each)


def per_key_limit(df: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def best_by(df: DataFrame, key: str, score: str) -> DataFrame:
    """The row of highest score of each key, the first of equals by ord."""
    order = F.struct((-F.col(score)).alias("s"), F.col("ord").alias("o"))
    others = [c for c in df.columns if c != key]
    return df.withColumn("__o", order).groupBy(key).agg(F.min_by(F.struct(*others), "__o").alias("r")).select(key, "r.*")
