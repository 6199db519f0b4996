"""Connected components of an edge table, distributed: alternating large-star and small-star rounds.

A node with many edges is combined before the shuffle where its least neighbour is sought, and its edges are dealt to
parts where they meet that neighbour, so no task gets the edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, looked_up, stored


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    moved = looked_up(both.filter("v > u"), least, ["u"], "n", 2 * total)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = looked_up(down, least, ["u"], "n", total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) long pairs -> (id, component): the smallest id reachable, for every id that has an edge.

    Null ends and loops are ignored; an empty table gives an empty result. Each round is stored in
    the shared scratch folder, and the previous one removed.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    seen = _print_of(edges)
    for _ in range(max_rounds):
        nxt = stored(_small_star(_large_star(edges, seen[0]).distinct(), seen[0]).distinct(), "edges")
        now = _print_of(nxt)
        dropped(edges)
        edges = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
