"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are equal texts. A group of at least 1 / SLICES of a shard's share of all bytes, tokens or rows is
cut into as many pieces, its rows dealt out by the hash of doc_id; all other groups stay whole. Pieces,
then groups, the largest first, go to the shard where the dot product of their vector with the shard's
residual capacity is highest. Pieces are few (at most 3 * SLICES a shard) and packed on the driver;
groups are dealt by hash to ranges of about PER_RANGE groups (MOST_RANGES at most), each of which has its
share of every shard's residual capacity and is packed by one task, group by group. Only sums of pieces, ranges and shards reach the
driver, whatever the input. Slots are numbered within (shard, range) and within LANES parts of each piece.

The law that holds is `bytes`: sizes are near equal as long as no single document exceeds a shard.

Defined results: a null text has size 16, crc32 0 and the group of all null texts; an empty text
likewise has size 16 and crc32 0; repeated rows each get a slot; null doc_ids are kept and come
first in their part; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored

SHARDS = 40
SLICES = 4
PER_RANGE, MOST_RANGES = 20_000, 8192
LANES = 16
OVERHEAD = 16
MEASURES = ("size", "tokens", "rows")


def pack(vectors: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Bin of each vector (items x dimensions) in the order given; residual (bins x dimensions) is used up.

    The bin of highest dot product among those the vector fits into, else among all; the first of equals.
    """
    out = np.zeros(len(vectors), np.int64)
    for k, v in enumerate(vectors):
        gain = residual @ v
        fits = (residual >= v).all(axis=1)
        out[k] = int(np.where(fits, gain, -np.inf).argmax()) if fits.any() else int(gain.argmax())
        residual[out[k]] -= v
    return out


def _packed(capacity: dict[int, np.ndarray]):
    """Places the groups of each range, which come range by range with the largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, residual = None, None
        for batch in batches:
            ranges = batch.column("range").to_numpy()
            vectors = np.stack([batch.column(m).to_numpy().astype(float) for m in ("size_share", "tokens_share", "rows_share")], 1)
            shard = np.zeros(len(ranges), np.int32)
            cuts = np.flatnonzero(np.diff(ranges, prepend=ranges[:1] - 1)) if len(ranges) else []
            for a, b in zip(cuts, [*cuts[1:], len(ranges)], strict=True):
                if ranges[a] != last:
                    # Every range begins at another shard, so that ties favour none.
                    last, residual = ranges[a], np.roll(capacity[int(ranges[a])], int(ranges[a]) * 7 + 3, axis=0)
                shard[a:b] = (pack(vectors[a:b], residual) - (int(last) * 7 + 3)) % len(residual)
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("text_crc32"), pa.array(shard)], names=["g", "text_crc32", "shard"])

    return run


def shards(docs: DataFrame, bins: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("g"),
            F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        ),
        "sizes",
    )
    measures = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*measures).first()
    whole = np.maximum(np.array([total[m] or 0 for m in MEASURES], float), 1.0)
    shares = [(F.col(m) / F.lit(float(w))).alias(f"{m}_share") for m, w in zip(MEASURES, whole, strict=True)]
    groups = rows.groupBy("g", "text_crc32").agg(*measures).select("*", *shares)
    most = F.greatest(*[F.col(f"{m}_share") for m in MEASURES])
    groups = groups.withColumn("most", most)
    groups = stored(groups.withColumn("pieces", F.floor(F.col("most") * (SLICES * bins)).cast("long")), "groups")

    ranges = min(MOST_RANGES, max(1, groups.count() // PER_RANGE))
    range_of = F.pmod(F.xxhash64("g", "text_crc32"), F.lit(ranges)).cast("int")

    # Pieces of large groups: their rows are dealt out, then the pieces are packed.
    large = groups.filter("pieces >= 1").select("g", "text_crc32", "pieces").orderBy("g", "text_crc32").collect()
    first, heavy = 0, []
    for row in large:
        heavy.append((row["g"], row["text_crc32"], row["pieces"], first))
        first += row["pieces"] * LANES
    own = F.broadcast(spark.createDataFrame(heavy, "g long, text_crc32 long, pieces long, first long"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    lane = F.pmod(drawn, F.col("pieces")) * LANES + F.pmod(F.floor(drawn / F.col("pieces")), F.lit(LANES))
    rows = rows.join(own, ["g", "text_crc32"], "left").withColumn("unit", F.col("first") + lane).drop("pieces", "first")
    residual = np.full((bins, len(MEASURES)), 1.0 / bins)
    placed: list[tuple[int, int, int]] = []  # unit, shard, rows
    if heavy:
        sums = rows.filter("unit is not null").groupBy("unit").agg(*measures).orderBy("unit").collect()
        names, place = np.unique([r["unit"] // LANES for r in sums], return_inverse=True)
        vectors = np.zeros((len(names), len(MEASURES)))
        np.add.at(vectors, place, np.array([[r[m] for m in MEASURES] for r in sums], float) / whole)
        order = np.lexsort((np.arange(len(names)), -vectors.max(axis=1)))
        shard = np.zeros(len(names), np.int64)
        shard[order] = pack(vectors[order], residual)
        placed = [(r["unit"], int(shard[p]), r["rows"]) for r, p in zip(sums, place.tolist(), strict=True)]

    # All other groups, in ranges that share what is left of every shard.
    light = groups.filter("pieces < 1").withColumn("range", range_of)
    parts = light.groupBy("range").agg(*[F.sum(f"{m}_share").alias(m) for m in MEASURES]).collect()
    left = np.maximum(residual, 0.0)
    left = left / np.maximum(left.sum(axis=0), 1e-300)
    capacity = {r["range"]: left * np.array([r[m] for m in MEASURES]) for r in parts}
    dealt = light.repartition("range").sortWithinPartitions("range", F.desc("most"), "g", "text_crc32")
    where = dealt.select("range", "g", "text_crc32", "size_share", "tokens_share", "rows_share").mapInArrow(_packed(capacity), "g long, text_crc32 long, shard int")
    where = stored(where, "places")
    dropped(groups)
    light_rows = rows.filter("unit is null").join(where, ["g", "text_crc32"]).withColumn("unit", range_of.cast("long"))
    names = ["doc_id", "size", "text_crc32", "g", "unit", "shard"]
    of_unit = F.broadcast(spark.createDataFrame([(u, k) for u, k, _ in placed], "unit long, shard int"))
    every = light_rows.select(*names).unionByName(rows.filter("unit is not null").withColumn("shard", F.lit(None).cast("int")).drop("shard").join(of_unit, "unit").withColumn("unit", F.col("unit") + ranges).select(*names))
    every = stored(every, "dealt")
    counts = every.groupBy("shard", "unit").agg(F.count("*").alias("n")).orderBy("shard", "unit").collect()
    filled = [0] * bins
    starts = []
    for r in counts:  # one for each range of a shard and the parts of pieces
        starts.append((r["shard"], r["unit"], filled[r["shard"]]))
        filled[r["shard"]] += r["n"]
    places = F.broadcast(spark.createDataFrame(starts, "shard int, unit long, start long"))
    order = Window.partitionBy("shard", "unit").orderBy("doc_id", "text_crc32", "size", "g")
    return every.withColumn("place", F.row_number().over(order)).join(places, ["shard", "unit"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
