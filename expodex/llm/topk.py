"""Exact top-k inner-product search by no-random-access aggregation.

Rows are packed into blocks, each with one list per component, sorted both ways. For a block of
queries the lists are read from their better end to a growing depth; a row's score then lies
between a lower bound (unread components at their worst) and an upper bound (unread components at
the depth's frontier), both had by matrix products. Reading stops for a query as soon as few enough
rows have an upper bound that reaches the k-th lower bound: no outsider can qualify, and the final
scores of the rest are resolved exactly. Each pair of blocks yields k rows a query; the best k of
those are the answer. Blocks, not rows, are paired, and every row of the query set meets every row.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null
vec_id, take no part; shorter vectors count as followed by zeros; rows with the query's vec_id are
the query's own; of a repeated query id the least vector is asked once; repeated candidates count
as often as they occur; fewer than k candidates are all returned; an empty table gives an empty
result; very large components are computed in 64-bit integers; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK, SUB = 16384, 512, 128
DEPTHS = (0.5, 0.75, 0.9, 0.95, 0.99)
#: The first queries of a block, whose reading is tried at every depth; that of others begins where one of these stopped.
PROBES = 4
#: A query's reading stops once at most this share of a block's rows can still qualify.
RESOLVE = 1 / 32


def usable(vectors: DataFrame) -> DataFrame:
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter("vec_id is not null and embedding is not null").filter(~F.coalesce(bad, F.lit(True)))


def _packed(limit: int):
    def pack(ids: list, values: list) -> pa.RecordBatch:
        width = max((len(v) for v in values), default=0)
        matrix = np.zeros((len(values), width), np.int64)
        for k, v in enumerate(values):
            matrix[k, : len(v)] = np.floor(64.0 * v)
        kind = np.int32 if not matrix.size or np.abs(matrix).max() < 2**31 else np.int64
        return pa.RecordBatch.from_arrays(
            [pa.array([np.array(ids, np.int64).tobytes()]), pa.array([matrix.astype(kind).tobytes()]), pa.array([kind().itemsize], pa.int32())],
            names=["ids", "matrix", "bytes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            column = batch.column("embedding")
            offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            values += [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            while len(ids) >= limit:
                yield pack(ids[:limit], values[:limit])
                ids, values = ids[limit:], values[limit:]
        if ids:
            yield pack(ids, values)

    return run


def _unpacked(ids: bytes, matrix: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(matrix, np.int32 if size == 4 else np.int64).reshape(len(ids), -1)


class Lists:
    """The sorted lists of a block of rows, read to a depth."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, most: float):
        """most: highest absolute value of a query's component."""
        self.ids, self.rows = ids, rows
        bound = float(np.abs(rows).max(initial=0)) * most * max(rows.shape[1], 1)
        self.kind = np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64
        self.ordered = np.sort(rows, axis=0)
        self.least, self.most = self.ordered[0], self.ordered[-1]
        self.full = np.ascontiguousarray(rows.T.astype(self.kind))
        self.read: dict[float, tuple[np.ndarray, np.ndarray]] = {}
        self.begin: int | None = None  # place in DEPTHS

    def bounds(self, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bounds of every row's products once the lists are read to the depth; made when first asked for."""
        if depth not in self.read:
            rows = self.rows
            read = min(len(rows) - 1, int(depth * len(rows)))
            high, low = self.ordered[len(rows) - 1 - read], self.ordered[read]  # the frontiers, from above and from below
            upper = np.concatenate([np.maximum(rows, high), np.minimum(rows, low)], 1)
            lower = np.concatenate([np.where(rows >= high, rows, self.least), np.where(rows <= low, rows, self.most)], 1)
            self.read[depth] = tuple(np.ascontiguousarray(x.T.astype(self.kind)) for x in (upper, lower))
        return self.read[depth]

    def best(self, names: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, vec_ids, scores) of the k best rows of the block for each query."""
        width = min(queries.shape[1], self.rows.shape[1])
        queries = np.concatenate([queries[:, :width], np.zeros((len(queries), self.rows.shape[1] - width), queries.dtype)], 1).astype(self.kind)
        both = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], 1)
        out_of = np.iinfo(np.int64).min // 4 if self.kind is np.int64 else -np.inf
        open_ = np.arange(len(queries))
        n = len(self.ids)
        if n <= k:  # no outsiders: every row's score is final
            for q in range(len(queries)):
                at = np.flatnonzero(self.ids != names[q])
                yield self._first(int(names[q]), at, queries[q] @ self.full[:, at], k)
            return
        def read_on(open_: np.ndarray, begin: int) -> Iterator[tuple[int, int, np.ndarray]]:
            """(place of the depth where reading stops, query, rows that can still qualify)"""
            for place in range(begin, len(DEPTHS)):
                if not len(open_):
                    return
                upper, lower = self.bounds(DEPTHS[place])
                low = both[open_] @ lower
                low[self.ids == names[open_, None]] = out_of
                reach = np.partition(low, n - k, axis=1)[:, n - k]
                can = both[open_] @ upper >= reach[:, None]
                can &= self.ids != names[open_, None]
                few = (can.sum(axis=1) <= max(2 * k, RESOLVE * n)) | (place == len(DEPTHS) - 1)  # at last, whatever can still qualify
                yield from ((place, q, np.flatnonzero(row)) for q, row in zip(open_[few].tolist(), can[few], strict=True))
                open_ = open_[~few]

        stopped = []
        for part in (open_[:PROBES], open_[PROBES:]):
            for place, q, at in read_on(part, self.begin or 0):
                stopped.append(place)
                yield self._first(int(names[q]), at, queries[q] @ self.full[:, at], k)
            if self.begin is None:
                self.begin = min(stopped, default=0)

    def _first(self, name: int, at: np.ndarray, score: np.ndarray, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[at], -score))[:k]
        return name, self.ids[at[order]], score[order].astype(np.int64)


def _met(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lists = None, None
        for batch in batches:
            for pair in batch.to_pylist():
                names, queries = _unpacked(pair["q_ids"], pair["q_matrix"], pair["q_bytes"])
                most = float(np.abs(queries).max(initial=0))
                if last != (pair["block"], most):
                    last, lists = (pair["block"], most), Lists(*_unpacked(pair["ids"], pair["matrix"], pair["bytes"]), most)
                asked, found, score = [], [], []
                for at in range(0, len(names), SUB):
                    for name, ids, scores in lists.best(names[at : at + SUB], queries[at : at + SUB], k):
                        asked.append(np.full(len(ids), name))
                        found.append(ids)
                        score.append(scores)
                if asked:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (asked, found, score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` of highest integer inner product for each row of `queries`."""
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blob = "ids binary, matrix binary, bytes int"
    parts = max(1, vectors.sparkSession.sparkContext.defaultParallelism)
    blocks = usable(vectors).coalesce(2 * parts).mapInArrow(_packed(BLOCK), blob).withColumn("block", F.xxhash64("ids", F.crc32("matrix")))
    asked = asked.mapInArrow(_packed(QUERY_BLOCK), blob).select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("bytes").alias("q_bytes"))
    asked = asked.withColumn("q_block", F.xxhash64("q_ids", F.crc32("q_matrix"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = blocks.withColumn("part", F.pmod("block", F.lit(parts)).cast("int")).join(asked, "part")
    # A fixed number of tasks: pairs are few and heavy, so they are not to be gathered by their bytes.
    pairs = pairs.repartition(4 * parts, "block", "q_block").sortWithinPartitions("block")
    met = pairs.select("block", "ids", "matrix", "bytes", "q_ids", "q_matrix", "q_bytes").mapInArrow(_met(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
