"""Near-duplicate groups by SimHash fingerprints and pigeonhole blocks.

A fingerprint is split into one block more than the bits that two linked ones may differ in, so linked
ones share a block. Distinct fingerprints meet in the buckets of their blocks; a bucket of more than
MEMBERS is split by the blocks of the remaining bits, which linked members share one of as well; what
is still larger (a cloud of fingerprints that are close indeed) is dealt into blocks of which every two
meet. Inside a bucket, Hamming distances decide; of the links found, a spanning forest leaves it.

Equal fingerprints are one class from the start, so copies, however many, are no links.

Defined results: null, empty and blank texts have the fingerprint zero and are linked like any other;
a text of fewer words than the width has one shingle; repeated rows and repeated doc_ids come back as
often as they occur, each with the component of its own fingerprint; a null doc_id gets a fingerprint
and a component, which is null where no member has a doc_id; very long texts are read whole; an empty
table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _FOLD, bounded_batches, chunks, dropped, flat_bytes, looked_up, stored, words
from .graph import components

WIDTH, SEED, DISTANCE, BITS = 4, 42, 4, 64
#: Shingles that are hashed at once.
SHINGLES = 1 << 15
#: Members of a bucket that are compared in one group.
MEMBERS = 2048
#: Groups up to this size are looked through together, row against row at growing distance.
SMALL = 64


def fingerprints_of(flat: np.ndarray, offsets: np.ndarray, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The fingerprint of every text flat[offsets[k]:offsets[k + 1]]."""
    starts, ends, _, first = words(flat, offsets)
    held = np.diff(first)
    number = np.where(held >= width, held - width + 1, np.minimum(held, 1))
    owner = np.repeat(np.arange(len(held)), number)
    begin = np.arange(len(owner)) + np.repeat(first[:-1] - (np.cumsum(number) - number), number)
    end = begin + np.minimum(held, width)[owner]
    ones = np.zeros((len(held), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(begin), SHINGLES):
        b = min(a + SHINGLES, len(begin))
        low, high = begin[a], end[b - 1]
        # The words of these shingles, lower-cased, with a single space after each.
        size = ends[low:high] - starts[low:high]
        to = np.concatenate([[0], np.cumsum(size + 1)])
        upto = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        line = np.full(to[-1], 32, np.uint8)
        line[step + np.repeat(to[:-1] - upto, size)] = _FOLD[flat[step + np.repeat(starts[low:high] - upto, size)]]
        text = line.tobytes()
        spans = zip(to[begin[a:b] - low].tolist(), (to[end[a:b] - low] - 1).tolist(), strict=True)
        hashed = np.fromiter((digest(text[x:y], seed) for x, y in spans), np.uint64, b - a)
        bits = np.unpackbits(hashed.astype(">u8").view(np.uint8)).reshape(-1, BITS)
        cut = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
        ones[owner[a:b][cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > number[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _signed(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            made = fingerprints_of(*flat_bytes(batch.column("text")), width, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "f"])

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, f (the fingerprint's 64 bits as a long) of every row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signed(width, seed), "doc_id long, f long")


def _forest(own: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that join the linked members of one group: each is held against those that no link has reached."""
    u, v, left = [], [], own
    while len(left) > 1:
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            x = waiting.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                u += [int(x)] * int(near.sum())
                v += left[near].tolist()
                waiting.extend(left[near])
                left = left[~near]
    return u, v


def forests(group: np.ndarray, own: np.ndarray, distance: int = DISTANCE) -> tuple[list[int], list[int]]:
    """Links that join the linked members of every group; group: rising numbers, own: the members' bits."""
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    size = np.diff(np.append(first, len(group)))
    wide = np.repeat(size > SMALL, size)
    linked = wide.copy()
    for step in range(1, int(size[size <= SMALL].max(initial=1))):
        near = (group[step:] == group[:-step]) & ~wide[step:] & (np.bitwise_count(own[step:] ^ own[:-step]) <= distance)
        linked[step:] |= near
        linked[:-step] |= near
    group, own = group[linked], own[linked]
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)).tolist()
    u, v = [], []
    if not first:
        return u, v
    for a, b in zip(first, [*first[1:], len(group)], strict=True):
        x, y = _forest(own[a:b], distance)
        u += x
        v += y
    return u, v


def _linked(distance: int):
    def links(key: list[np.ndarray], own: np.ndarray) -> pa.RecordBatch:
        change = np.zeros(len(own), bool)
        for column in key:
            change[1:] |= column[1:] != column[:-1]
        u, v = forests(np.cumsum(change), own, distance)
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the group that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            *key, own = (batch.column(c).to_numpy() for c in ("bucket", "low", "high", "f"))
            rows = [*key, own.view(np.uint64)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            *key, own = rows
            whole = np.ones(len(own), bool)
            for column in key:
                whole &= column == column[-1]
            cut = len(own) - int(whole.sum())
            held = [x[cut:] for x in rows]
            if cut:
                yield links([x[:cut] for x in key], own[:cut])
        if held is not None:
            yield links(held[:-1], held[-1])

    return run


def _block(bits: Column, low: Column, high: Column) -> Column:
    """Bits low to high (not included) of a long."""
    return F.call_function("shiftrightunsigned", bits, low.cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (high - low).cast("int")) - 1)


def dealt(distinct: DataFrame, distance: int = DISTANCE, members: int = MEMBERS) -> DataFrame:
    """bucket, low, high, f: the groups in which fingerprints (column f) are compared, a row for each group of each."""
    blocks = distance + 1
    numbers = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(BITS * k // blocks).alias("from"), F.lit(BITS * (k + 1) // blocks).alias("to")) for k in range(blocks)])
    rows = distinct.select("f", F.explode(numbers).alias("b")).select("f", "b.*")
    wide = -(-BITS // blocks)
    rows = rows.select("f", "from", "to", (F.col("t") * (1 << wide) + _block(F.col("f"), F.col("from"), F.col("to"))).alias("bucket"))
    # Buckets are at most blocks * 2^wide, whatever the table's size.
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    rows = rows.join(F.broadcast(sizes.filter("n > 1")), "bucket")
    once = rows.filter(F.col("n") <= members).select("bucket", "f", F.lit(1).alias("parts"))
    # The bits beside the block, again in blocks, of which close members of a bucket share one.
    above = F.when(F.col("to") < BITS, F.call_function("shiftrightunsigned", F.col("f"), F.col("to").cast("int"))).otherwise(F.lit(0).cast("long"))
    rest = F.call_function("shiftleft", above, F.col("from").cast("int")).bitwiseOR(_block(F.col("f"), F.lit(0), F.col("from")))
    again = rows.filter(F.col("n") > members).select("bucket", "f", rest.alias("rest"), (F.lit(BITS) - F.col("to") + F.col("from")).alias("bits"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("t"))
    low, high = F.expr(f"bits * t div {blocks}"), F.expr(f"bits * (t + 1) div {blocks}")
    inner = (F.col("bucket") + 1) * (1 << 24) + F.col("t") * (1 << wide) + _block(F.col("rest"), low, high)
    again = again.select(inner.alias("bucket"), "f")
    counted = again.groupBy("bucket").agg(F.count("*").alias("n"))
    total = 0 if sizes.filter(F.col("n") > members).isEmpty() else again.count()
    counted = counted.filter("n > 1").withColumn("parts", F.ceil(F.col("n") / F.lit(float(members))).cast("int"))
    again = looked_up(again, counted, ["bucket"], "n", total).select("bucket", "f", "parts")
    part = F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")
    every = once.unionByName(again).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return every.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "f")


def links(distinct: DataFrame, distance: int = DISTANCE, members: int = MEMBERS) -> DataFrame:
    """(u, v): links among distinct fingerprints (column f) that join all that are linked, directly or by others."""
    groups = dealt(distinct, distance, members).repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return groups.mapInArrow(_linked(distance), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs; see the module's docstring.

    distance: most bits in which linked fingerprints differ.
    """
    bounded_batches(docs)
    rows = stored(fingerprints(docs, width, seed), "fingerprints")
    classes = stored(rows.groupBy("f").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    joined = stored(links(classes.select("f"), distance), "links")
    groups = stored(components(joined).select(F.col("id").alias("f"), "component").join(classes.select("f", "rep"), "f"), "groups")
    least = groups.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    named = looked_up(groups.select("f", "component"), least, ["component"], "n", groups.count()).select("f", "least")
    named = classes.join(named, "f", "left").select("f", "n", F.coalesce("least", "rep").alias("component_id"))
    out = looked_up(rows, named, ["f"], "n", rows.count())
    dropped(joined)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
