"""Centroid clustering of quantised vectors with weighted deduplication.

Components become integers; identical vectors become one row with its multiplicity. Lloyd rounds run
on the distinct vectors: every task finds the nearest centroids and adds up integer sums, weighted by
multiplicity, so a round moves one row a task and centroid, and k rows reach the driver. At the end
the assignments of distinct vectors are joined back to all vec_ids.

Everything is integer arithmetic, hence exact and the same in every run.

Defined results: vectors that are null, have another number of components than asked, or hold null or
non-finite components take no part; quantised components are held within 2^27 in magnitude, so that
distances fit 64 bits; repeated rows count as often as they occur and each comes back; a null vec_id
is named `null` when first centroids are drawn; rows drawn with the same digest follow the order of
their vectors; with fewer vectors than k there are as many centroids as vectors; a sum of distances beyond 64 bits
is null; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, looked_up, stored

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
LIMIT = 1 << 27
#: Components that are looked at at once.
CELLS = 1 << 20
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of every component x, for the vectors that take part."""
    x = F.col(column).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = vectors.filter((F.size(x) == dims) & F.coalesce(sound, F.lit(False)))
    whole = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return held.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of every row of v, exact; the smaller number of equally near ones."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if v.shape[1] * (2 * most) ** 2 < 2**53:  # every sum is exact in a double
        a, c = v.astype(float), centroids.astype(float)
        apart = ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    else:
        apart = np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)
    to = apart.argmin(axis=1)
    return to, apart[np.arange(len(v)), to]


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, CELLS // max(1, dims))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _summed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        sums, weights = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in _slices(batches, dims):
            v, w = _matrix(batch.column("v"), dims), batch.column("w").to_numpy()
            to, _ = nearest(v, centroids)
            order = np.argsort(to, kind="stable")
            first = np.flatnonzero(np.diff(to[order], prepend=-1))
            own = to[order][first]
            sums[own] += np.add.reduceat(v[order] * w[order, None], first, axis=0)
            weights[own] += np.add.reduceat(w[order], first)
        used = np.flatnonzero(weights)
        if len(used):
            columns = [pa.array(used.astype(np.int32)), pa.array(weights[used]), *(pa.array(c) for c in sums[used].T)]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "w", *(f"s{j}" for j in range(dims))])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, centroids.shape[1]):
            to, apart = nearest(_matrix(batch.column("v"), centroids.shape[1]), centroids)
            columns = [*(batch.column(c) for c in ("h1", "h2", "w")), pa.array(to.astype(np.int32)), pa.array(apart)]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "w", "cluster", "distance"])

    return run


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over distinct vectors (v, w): floors of the means, empty ones as they were."""
    names = [f"s{j}" for j in range(centroids.shape[1])]
    partial = distinct.select("v", "w").mapInArrow(_summed(centroids), "cluster int, w long, " + ", ".join(f"{c} long" for c in names))
    out = centroids.copy()
    for row in partial.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("w", *names)]).collect():  # k rows at most
        out[row["cluster"]] = [row[c] // row["w"] for c in names]
    return out


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part; see the module's docstring."""
    spark = vectors.sparkSession
    rows = quantised(vectors, dims, scale)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = rows.select(drawn.alias("draw"), "v").orderBy("draw", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], SCHEMA)
    centroids = np.array([r["v"] for r in first], np.int64)
    # A vector's name in joins: 128 bits, so that the vectors themselves are shuffled once, as partial counts.
    named = [F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")]
    distinct = stored(rows.groupBy("v").agg(F.count("*").alias("w")).select(*named, "v", "w"), "distinct")
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    assigned = stored(distinct.mapInArrow(_assigned(centroids), "h1 long, h2 long, w long, cluster int, distance long"), "assigned")
    dropped(distinct)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)") * F.col("w")).alias("apart"), F.sum("w").alias("w")).collect()
    fits = lambda n: int(n) if n < 2**63 else None
    inertia = fits(sum(r["apart"] for r in sums))
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(r["cluster"], fits(r["apart"]), inertia, digest[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    back = looked_up(rows.select("vec_id", *named), assigned, ["h1", "h2"], "w", sum(r["w"] for r in sums))
    return back.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
