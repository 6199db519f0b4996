"""Near-duplicate groups by min-max hashing.

Every permutation of the shingle hashes yields two signature values, its minimum and its maximum,
so ROWS * BANDS values cost half as many hash evaluations. Rows that agree on a band become
candidates; candidates are confirmed on full shingle sets; components are taken over confirmed
links. Groups never expand into all their pairs:

1. documents with equal shingle sets collapse to one representative (smallest doc_id);
2. in every band bucket each member is tried against one hub, the bucket's smallest representative;
3. buckets whose members still lie in different components are compared in bounded blocks, by matrix
   products; no pair becomes a row unless it joins two components.

Defined results: null, empty and blank texts have an empty set (n_shingles 0), are linked with
nothing and kept; a text of fewer words than the width has one shingle; repeated rows and repeated
doc_ids are returned as often as they occur, under the same component; a null doc_id is linked with
nothing, has a null component and is kept; an empty table gives an empty result; other columns of
the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, dropped, flat_bytes, mix, shingles, stored, words
from .graph import components

ROWS, BANDS = 6, 42
PERMUTATIONS = ROWS * BANDS // 2
SIMILARITY = 80  # percent
_rng = np.random.default_rng(5)
_MUL = (_rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_WEIGHT = _rng.integers(0, 2**63, 2 * PERMUTATIONS, dtype=np.uint64) | np.uint64(1)

#: Members of a bucket that are held against a copy of their hub.
MEMBERS = 512
#: Rows of a cluster that are compared at once with as many others, and shingles in one matrix product.
BLOCK, SLICE = 256, 4096
#: Blocks of long texts are smaller: about so many shingles each.
BLOCK_SHINGLES = 1 << 18

#: Slots of the fixed-size membership bitmap that spares the verification of shuffling other texts.
BITMAP_WORDS = 1 << 18


def signature(hashed: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the distinct 64-bit hashes under each permutation of their upper 32 bits."""
    low = (hashed >> np.uint64(32)).astype(np.uint32)
    least, most = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(low), 512):
            block = low[at : at + 512, None] * _MUL
            block += _ADD
            np.minimum(least, block.min(axis=0), out=least)
            np.maximum(most, block.max(axis=0), out=most)
    return np.concatenate([least, most])


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """(documents, values) -> (documents, BANDS) 64-bit band keys."""
    with np.errstate(over="ignore"):
        weighed = mix(signatures.astype(np.uint64) * _WEIGHT).reshape(len(signatures), BANDS, ROWS)
        return mix(weighed.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            flat, offsets = flat_bytes(batch.column("text"))
            _, _, hashed, first = words(flat, offsets)
            size, one, two, signs = [], [], [], []
            with np.errstate(over="ignore"):
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own = np.unique(shingles(hashed[a:b], width))
                    size.append(len(own))
                    one.append(own.sum(dtype=np.uint64))
                    two.append(mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    signs.append(signature(own))
            keys = bands_of(np.array(signs, np.uint32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(np.array(one, np.uint64).view(np.int64)),
                    pa.array(np.array(two, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel())),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "bands"],
            )

    return run


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (128 bits that stand for the set), bands."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        _signed(width), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"
    )


def _confirmed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in chunks(batches, "text"):
            u, v = [], []
            for hub, name, text in zip(batch.column("hub").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if hub == name:  # sorted before all that are held against it
                    last, own = hub, _set_of(text.as_py(), width)
                    continue
                if hub != last:
                    raise ValueError(f"document {hub} is missing")
                both = np.concatenate([own, _set_of(text.as_py(), width)])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= percent * (len(both) - same):
                    u.append(hub)
                    v.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _set_of(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingles(words(*_flat(text))[2], width))


def _held(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """rows with __held: false only if the key is surely none of the ids (column `id`).

    A bitmap of 2^24 bits, at most BITMAP_WORDS rows whatever the table's size, goes to every task.
    """
    word = lambda c: F.pmod(F.shiftrightunsigned(F.xxhash64(c), 6), F.lit(BITMAP_WORDS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(xxhash64(`{c}`) & 63 as int))")
    bitmap = ids.select(word("id").alias("__word"), bit("id").alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    rows = rows.withColumn("__word", word(key)).join(F.broadcast(bitmap), "__word", "left")
    return rows.withColumn("__held", F.coalesce(F.col("__bits").bitwiseAND(bit(key)) != 0, F.lit(False))).drop("__word", "__bits")


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows with these ids, and few others: those are dropped before any text is shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    return _held(rows, "id", ids).filter("__held").select("id", "text")


def _links(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are as similar as asked.

    Texts move twice: to their pairs, then to their hubs, a hub with many members being split into
    parts of about MEMBERS that each get the hub's text.
    """
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(float(MEMBERS))).cast("int").alias("parts"))
    members = pairs.join(parts, "u").select(F.col("v").alias("id"), F.col("u").alias("hub"), F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    hubs = parts.select(F.col("u").alias("id"), F.col("u").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = stored(members.unionByName(hubs), "wanted")
    texts = _with_ids(docs, wanted.select("id").distinct())
    full = wanted.join(texts, "id").repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))
    links = stored(full.select("hub", "id", "text").mapInArrow(_confirmed(width, percent), "u long, v long"), "links")
    dropped(wanted)
    return links


def _compared(width: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        own = [np.unique(shingles(words(*_flat(t))[2], width)) for t in table.column("text").to_pylist()]
        size = np.array([len(x) for x in own])
        owner = np.repeat(np.arange(len(own)), size)
        _, place, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        several = count[place] > 1
        number = (np.cumsum(count > 1) - 1)[place[several]]
        owner = owner[several]
        same = np.zeros((len(own), len(own)), np.float32)
        for at in range(0, int(number.max(initial=-1)) + 1, SLICE):
            held = np.zeros((len(own), SLICE), np.float32)
            inside = (number >= at) & (number < at + SLICE)
            held[owner[inside], number[inside] - at] = 1
            same += held @ held.T
        linked = 100 * same >= percent * (size[:, None] + size[None, :] - same)
        group = table.column("component").to_numpy()
        linked &= group[:, None] != group[None, :]
        # Of the links found, a spanning forest of the groups suffices.
        to: dict[int, int] = {}

        def root(x: int) -> int:
            while to.setdefault(x, x) != x:
                to[x] = to[to[x]]
                x = to[x]
            return x

        ids, u, v = table.column("rep").to_pylist(), [], []
        for i, j in np.argwhere(np.triu(linked)).tolist():
            x, y = root(int(group[i])), root(int(group[j]))
            if x != y:
                to[x] = y
                u.append(min(ids[i], ids[j]))
                v.append(max(ids[i], ids[j]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _flat(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer((text or "").encode(), np.uint8)
    return flat, np.array([0, len(flat)])


def _block_links(docs: DataFrame, rest: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between different components among the members of unsettled buckets: (rep, component, hub, n_shingles).

    Buckets that share members form clusters. A cluster's members are dealt into blocks of about
    BLOCK rows and BLOCK_SHINGLES shingles at most, and every two blocks of a cluster meet in one bounded group, where intersections are
    counted by matrix products; only links that join components leave it.
    """
    clusters = components(rest.select(F.col("rep").alias("u"), F.col("hub").alias("v")))
    member = rest.select("rep", "component", "n_shingles").distinct().join(clusters.withColumnRenamed("id", "rep").withColumnRenamed("component", "cluster"), "rep")
    held = member = stored(member, "members")
    load = F.greatest(F.count("*") / F.lit(float(BLOCK)), F.sum("n_shingles") / F.lit(float(BLOCK_SHINGLES)))
    sizes = member.groupBy("cluster").agg(F.ceil(load).cast("int").alias("blocks"))
    member = member.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = _with_ids(docs, member.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep")
    dealt = member.join(texts, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("rep", "component", "text", "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    late = stored(dealt.groupBy("cluster", "low", "high").applyInArrow(_compared(width, percent), "u long, v long"), "late")
    dropped(held)
    return late


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; see the module's docstring.

    width: words in a shingle. percent: least similarity of a link, as 100 * intersection / union.
    """
    bounded_batches(docs)
    rows = stored(signed(docs, width), "signed")
    linked = rows.filter("n_shingles > 0 and doc_id is not null")
    # A doc_id with several different texts is represented by each of its sets; links join them by id.
    classes = linked.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    members = classes.select("rep", F.explode("bands").alias("band"))
    hubs = members.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).filter("hub <> top").select("band", "hub")
    shared = stored(members.join(hubs, "band"), "buckets")
    sizes = classes.select("rep", "n_shingles")
    first = shared.filter("rep <> hub").select(F.col("hub").alias("u"), F.col("rep").alias("v")).distinct()
    first = first.join(sizes.toDF("u", "n_u"), "u").join(sizes.toDF("v", "n_v"), "v").filter(f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)")
    first = stored(first.select("u", "v").distinct(), "pairs")
    links = _links(docs, first, width, percent)
    groups = stored(components(links), "groups")
    # Buckets of three and more that the hub did not bring together: their members are compared in blocks.
    spread = shared.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    split = spread.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.min("rep").alias("hub"))
    rest = spread.join(split.filter("low <> high and n > 2").select("band", "hub"), "band")
    rest = stored(rest.select("rep", "component", "hub").distinct().join(sizes, "rep"), "rest")
    late = _block_links(docs, rest, width, percent)
    # Rows find their class by its set, so copies, however many, are no edges; a doc_id of several texts joins their classes.
    named = stored(
        rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("h1")).alias("h1"), "h2")
        .join(classes.select("h1", "h2", "n_shingles", "rep"), ["h1", "h2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", "rep"),
        "named",
    )
    several = named.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("top")).filter("u <> top").select("doc_id", "u")
    several = named.join(several, "doc_id").select("u", F.col("rep").alias("v")).filter("u <> v")
    groups = components(links.unionByName(late).unionByName(several))
    for done in (rows, classes, shared, first, links, rest, late):  # what follows reads `named` and `groups` alone
        dropped(done)
    out = named.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """The rows of docs, with all columns, that are kept: one of each group of near copies.

    Rows are judged, not ids: where rows share a doc_id, each different text of it stays unless it is a
    near copy of a row that stays; of near copies the least doc_id, then the least text does. Rows with
    a null doc_id all stay, and so do those without words, one of each doc_id.
    """
    number = F.col("doc_id").cast("long")
    counted = docs.agg(F.count(number).alias("n"), F.count_distinct(number).alias("d")).first()
    if counted["n"] != counted["d"]:
        return _one_row_of_each(docs, width, percent)
    judged = near_duplicates(docs, width, percent).select("doc_id", "kept")
    judged = stored(judged, "kept")
    gone = judged.filter("not kept").select(F.col("doc_id").alias("id")).distinct()
    # Only rows whose id may be among those that go are shuffled to see whether it is. Columns go by place, whatever their names.
    inner = [f"c{k}" for k in range(len(docs.columns))]
    marked = _held(docs.toDF(*inner).withColumn("__id", F.col(inner[docs.columns.index("doc_id")]).cast("long")), "__id", gone)
    doubtful = marked.filter("__held").join(gone.withColumnRenamed("id", "__id"), "__id", "left_anti")
    return marked.filter("not __held").select(inner).unionByName(doubtful.select(inner)).toDF(*docs.columns)


def _one_row_of_each(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """one_of_each() of rows whose doc_id may repeat: rows are numbered in the order of doc_id and text, and judged by number."""
    names, number = docs.columns, F.col("doc_id").cast("long")
    others = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("__0"), *[c for c in names if c not in ("doc_id", "text")])))
    rows = docs.filter(number.isNotNull()).orderBy(number, "text", others)
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    judged = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), width, percent).filter("kept")
    left = rows.join(stored(judged.select(F.col("doc_id").alias("__row"), "n_shingles"), "kept").withColumnRenamed("n_shingles", "__words"), "__row")
    blank = left.filter("__words = 0").groupBy(number.alias("__id")).agg(F.min("__row").alias("__row")).select("__row")
    left = left.filter("__words > 0").select(names).unionByName(left.join(blank, "__row", "left_semi").select(names))
    return left.unionByName(docs.filter(number.isNull()))
