"""Language-model scoring with a probabilistic suffix tree over words.

Root: the next-symbol distribution of the empty context, (c + 1) / (N + V + 1) for a token seen c
times among N training tokens of V kinds; an unknown token counts as c = 0. A context (the last 1 to
MAX_DEPTH tokens; a document's first token follows the end of another) becomes a state if it occurs
at least MIN_CONTEXT times and the Kullback-Leibler divergence of its next-symbol distribution from
that of its longest retained suffix reaches DIVERGENCE. A state keeps the symbols that occur with it
at least MIN_CELL times, discounted by DISCOUNT; the rest of its mass goes to the suffix's
distribution. Each token is scored in its longest suffix state. The thresholds are counts, the same
at every size, so the tree grows with the corpus.

A state hangs on its last token, so all contexts that end in one token grow apart from all others.
scores() sends each occurrence once, as the codes of its last MAX_DEPTH + 1 tokens, to the part that
its context's last token names; there the states of all lengths are made and each row's occurrences
are summed up. A part holds about _OCCURRENCES of them and works in steps of about _STEP. Contexts that would
fill a part alone (large) are counted beforehand; their occurrences go by the next longer context, and
meet the chances of their cells, as they meet the root's counts, in a broadcast table of the HEAVY most frequent ones
and, for the rest, by a join on the hashes that a part wants. Occurrences travel in packets, one a part and flush of rows;
a part gives back one packet for each that it got, so the rows of tables do not grow with parts and rows.
Tokens that occur once, or too seldom for a context, have one code. Filters of at most 2^FILTER_BITS
bits tell most of them; they change no result. Grams are named by 64-bit hashes.

trained() gives the tree itself as tables, for looking at it: root and levels are counted and joined
gram by gram. scores() does not use it.

Defined results: null and empty texts consist of the end alone; repeated rows are scored, and
counted in training, as often as they occur; rows with a null doc_id are neither held out (null)
nor used in training, and are scored; without training rows every token is unknown and N is 0;
long texts are read whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HashIndex, bounded_batches, chunks, dropped, flat_bytes, mix, stored, words

MAX_DEPTH = 3
MIN_CONTEXT = 4
MIN_CELL = 2
HEAVY = 1 << 19
DIVERGENCE = 0.05
DISCOUNT = 0.5
FILTER_BITS = 28
END = np.uint64(0xE4D0F7E4DE4DE4DF)
_SLICE = 8  # bits of a hash that name its part of a filter
_FLUSH = 1_500_000
_PIECE = 50_000


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the rows' tokens, an END after each row's words; where each row begins [+1])."""
    _, _, hashed, first = words(*flat_bytes(batch.column("text")))
    rows = len(first) - 1
    out = np.full(len(hashed) + rows, END, np.uint64)
    begins = first + np.arange(rows + 1)
    held = np.ones(len(out), bool)
    held[begins[1:] - 1] = False
    out[held] = hashed
    return out, begins


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of the gram with this prefix and this suffix (each one token shorter)."""
    with np.errstate(over="ignore"):
        return mix(context * np.uint64(0xD6E8FEB86659FD93) + suffix)


def grams(token: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the last token, hash, prefix, suffix) of the grams of 1 .. order tokens; an END stands first or last only."""
    before = np.append(END, token[:-1])
    at = np.arange(len(token))
    yield at, token, token, token
    whole = token
    for k in range(2, order + 1):
        context = np.append(END if k == 2 else np.uint64(0), whole[:-1])
        if k > 2:  # the prefix must be a gram, and its last token no END
            place = np.zeros(len(token), bool)
            place[at] = True
            at = np.flatnonzero(np.append(False, place[:-1]) & (before != END))
        own = joined(context[at], whole[at])
        yield at, own, context[at], whole[at]
        whole = np.zeros(len(token), np.uint64)
        whole[at] = own


class Counter:
    """Sums of counts by 64-bit key, with further columns that the key determines, given out in pieces of bounded size."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *also: np.ndarray) -> None:
        own, first, n = np.unique(keys, return_index=True, return_counts=True)
        self.parts.append([own, n, *(x[first] for x in also)])
        self.size += len(own)

    def merged(self) -> list[np.ndarray]:
        keys, n, *also = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return [keys[at], np.add.reduceat(n, at) if len(at) else n, *(x[order[at]] for x in also)]

    def shrink(self) -> bool:
        """True if even the merged counts are too many to keep."""
        if self.size < _FLUSH:
            return False
        self.parts = [self.merged()]
        self.size = len(self.parts[0][0])
        return self.size > _FLUSH // 2

    def given(self) -> list[np.ndarray]:
        out = self.merged() if self.parts else []
        self.parts, self.size = [], 0
        return out


def _held(own: np.ndarray, context: np.ndarray, suffix: np.ndarray, wanted) -> np.ndarray:
    """Places of the grams whose prefix and suffix the filters hold."""
    held = np.flatnonzero(wanted.value[0](context))
    return held[wanted.value[1](suffix[held])]


def _counting(order: int, wanted=None, twice=None):
    """Counts of the batches' grams of one order: (h, n), or (ctx, suf, n) of those that the filters hold."""

    def batch(counter: Counter) -> Iterator[pa.RecordBatch]:
        given = counter.given()
        if given:
            keys, n, *also = given
            columns = [pa.array(x.view(np.int64)) for x in (also or [keys])] + [pa.array(n.astype(np.int64))]
            whole = pa.RecordBatch.from_arrays(columns, names=["h", "n"] if order == 1 else ["ctx", "suf", "n"])
            yield from (whole.slice(at, _PIECE) for at in range(0, len(n), _PIECE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for part in chunks(batches, "text"):
            *_, (_, own, context, suffix) = grams(tokens(part)[0], order)
            if order == 1:
                counter.add(own)
            else:
                held = _held(own, context, suffix, wanted)
                if twice is not None:
                    held = held[twice.value(own[held])]
                counter.add(own[held], context[held], suffix[held])
            if counter.shrink():
                yield from batch(counter)
        yield from batch(counter)

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a level with h: a cell's gram, a state's context."""
    for b in batches:
        context, suffix = (b.column(k).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for k in ("ctx", "suf"))
        h = np.where(b.column("state").to_numpy(zero_copy_only=False), context, joined(context, suffix))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(b.column(k) for k in b.schema.names if k != "ctx")], names=["h", *(k for k in b.schema.names if k != "ctx")])


_LEVEL = "h long, state boolean, suf long, n long, p double, w double, left double, kept boolean"


class Twice:
    """One bit a slot: whether more than one gram fell into it. Never denies a gram that occurs twice."""

    def __init__(self, bits: int):
        self.bits = bits
        self.held = np.zeros(1 << (bits - 3), np.uint8)

    def slots(self, h: np.ndarray) -> np.ndarray:
        return (mix(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self.slots(h)
        return ((self.held[at >> 3] >> (at & 7)) & 1).astype(bool)


def _gaps(places: np.ndarray) -> bytes:
    """Ascending places as 16-bit gaps; 65535 stands for that many places without an end."""
    gap = np.diff(places, prepend=-1)
    over = gap // 65535
    out = np.full(len(gap) + int(over.sum()), 65535, np.uint16)
    out[np.arange(len(gap)) + np.cumsum(over)] = gap % 65535
    return out.tobytes()


def _places(gaps: bytes) -> np.ndarray:
    gap = np.frombuffer(gaps, np.uint16).astype(np.int64)
    return (np.cumsum(gap) - 1)[gap != 65535]


def twice_of(texts: DataFrame, order: int, wanted, tokens_in_all: int) -> Twice | None:
    """Which slots more than one of the filtered grams of this order falls into; None where no filter of bounded size would spare any."""
    bits = max(20, int(4 * tokens_in_all).bit_length())
    if bits > FILTER_BITS + 3:
        return None
    out = Twice(min(FILTER_BITS, bits))
    size = 1 << (out.bits - _SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0

        def given() -> pa.RecordBatch:
            slot, n = np.unique(np.concatenate(parts), return_counts=True)
            cut = np.searchsorted(slot, np.arange((1 << _SLICE) + 1) * size)
            rows = [(k, _gaps(slot[a:b] - k * size), _gaps(slot[a:b][n[a:b] > 1] - k * size)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "once", "more"])

        for part in chunks(batches, "text"):
            *_, (_, own, context, suffix) = grams(tokens(part)[0], order)
            parts.append(out.slots(own[_held(own, context, suffix, wanted)]))
            held += len(parts[-1])
            if held > 4 * _FLUSH:
                yield given()
                parts, held = [], 0
        if held:
            yield given()

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = np.zeros(size, bool), np.zeros(size, bool)
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("more"), strict=True):
                at = _places(a.as_py())
                more[at] |= once[at]
                once[at] = True
                more[_places(b.as_py())] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(more, bitorder="little").tobytes()], pa.binary())], names=["part", "held"])

    for row in texts.mapInArrow(run, "part int, once binary, more binary").groupBy("part").applyInArrow(merged, "part int, held binary").toLocalIterator():
        out.held[row["part"] * (size >> 3) : (row["part"] + 1) * (size >> 3)] = np.frombuffer(row["held"], np.uint8)
    return out


class Filter:
    """A Bloom filter in parts: never denies a hash that was put in."""

    def __init__(self, width: int):
        self.width = width  # bits of a place within a part
        self.held = np.zeros((1 << _SLICE) << max(width - 3, 0), np.uint8)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, mask = mix(h ^ np.uint64(0x5851F42D4C957F2D)), np.uint64((1 << self.width) - 1)
        return (m & mask).astype(np.int64), ((m >> np.uint64(32)) & mask).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        part = (h >> np.uint64(64 - _SLICE)).astype(np.int64) << (self.width - 3)
        a, b = self.places(h)
        return ((self.held[part + (a >> 3)] >> (a & 7)) & (self.held[part + (b >> 3)] >> (b & 7)) & 1).astype(bool)


def filter_of(hashes: DataFrame) -> Filter:
    """A filter of the column h: its parts are made by the executors and joined here."""
    out = Filter(min(FILTER_BITS, max(16, int(hashes.count() * 12).bit_length())) - _SLICE)
    size = 1 << (out.width - 3)

    def part(key: tuple, rows: pa.Table) -> pa.Table:
        held = np.zeros(size << 3, bool)
        for at in out.places(rows.column("h").to_numpy().astype(np.int64).view(np.uint64)):
            held[at] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    parts = hashes.select("h", F.shiftrightunsigned("h", 64 - _SLICE).cast("int").alias("part"))
    for row in parts.groupBy("part").applyInArrow(part, "part int, held binary").collect():
        out.held[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["held"], np.uint8)
    return out


def _released(df: DataFrame) -> None:
    """Let Spark remove the shuffle files of finished queries, which nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


class Tree:
    """The tables of a tree: `root` (h, c), and each level's rows: its cells (state false: h, suf, n, p, w) and its states
    (state true: h is the context, n how often it occurs, left the mass of symbols not kept, w its weight, 0 unless kept)."""

    def __init__(self, root: DataFrame, total: int, kinds: int):
        self.root, self.total, self.kinds = root, total, kinds
        self.denominator = float(total + kinds + 1)
        self.tables: list[DataFrame] = []

    # What follows collects tables: it is for looking at small trees.

    @cached_property
    def _tokens(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self.root.toArrow()
        return rows["h"].to_numpy().view(np.uint64), rows["c"].to_numpy()

    @property
    def counts(self) -> np.ndarray:
        return self._tokens[1]

    @cached_property
    def levels(self) -> list[dict]:
        out = []
        for table in self.tables:
            rows = table.filter("state").select(F.col("h").alias("ctx"), "suf", "n", "left", "kept").toArrow().to_pydict()
            held = table.filter("not state").select("h", "p").toArrow().to_pydict()
            place = {c: k for k, c in enumerate(rows["ctx"])}
            out.append(rows | {"place": place, "kept": np.array(rows["kept"], bool), "p": dict(zip(held["h"], held["p"], strict=True))})
        return out

    def _met(self, context: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the context's grams with each token, chance of each token)."""
        if depth == 0:
            return self._tokens[0], (self.counts + 1.0) / self.denominator
        level = self.levels[depth - 1]
        down = self.levels[depth - 2]["place"][level["suf"][context]] if depth > 1 else -1
        suffix, lower = self._met(down, depth - 1)
        own = joined(np.full(len(suffix), level["ctx"][context], np.int64).view(np.uint64), suffix)
        rest = lower * (level["left"][context] if level["kept"][context] else 1.0)
        return own, np.array([level["p"].get(h, x) for h, x in zip(own.view(np.int64).tolist(), rest.tolist(), strict=True)])

    def chance(self, context: np.ndarray, token: np.ndarray, depth: int) -> np.ndarray:
        """P(token | context of `depth` tokens), by the longest retained suffix."""
        return np.array([self._met(int(c), depth)[1][t] for c, t in zip(context, token, strict=True)]) if len(set(context.tolist())) > 1 else self._met(int(context[0]), depth)[1][token]


def held_out_of():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2


def counted(texts: DataFrame) -> Tree:
    """A tree that is its root alone."""
    counts = stored(texts.mapInArrow(_counting(1), "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "counts")
    row = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    return Tree(counts, int(row["n"]), int(row["v"]))


def trained(rows: DataFrame) -> tuple[Tree, DataFrame]:
    """(the tree, the root's table h, c) from the rows' text."""
    spark = rows.sparkSession
    texts = rows.select("text")
    tree = counted(texts)
    counts = tree.root
    below = counts.select("h", F.lit(None).cast("long").alias("suf"), F.col("c").alias("n"), ((F.col("c") + 1.0) / F.lit(tree.denominator)).alias("p"))
    for depth in range(1, MAX_DEPTH + 1):
        often = below.filter(F.col("n") >= MIN_CONTEXT)
        wanted = spark.sparkContext.broadcast((filter_of(often), filter_of(below.filter(F.col("n") >= MIN_CELL))))
        twice = twice_of(texts, depth + 1, wanted, tree.total)
        twice = None if twice is None else spark.sparkContext.broadcast(twice)
        met = texts.mapInArrow(_counting(depth + 1, wanted, twice), "ctx long, suf long, n long").groupBy("ctx", "suf").agg(F.sum("n").alias("n"))
        met = met.filter(F.col("n") >= MIN_CELL).join(below.select(F.col("h").alias("suf"), F.col("p").alias("below")).hint("shuffle_hash"), "suf")
        before = stored(met, "met")
        for shared in (wanted, twice):
            if shared is not None:
                shared.destroy()
        _released(before)
        met = before.join(often.select(F.col("h").alias("ctx"), F.col("suf").alias("down"), F.col("n").alias("total")).hint("shuffle_hash"), "ctx")
        # The join has brought each context's cells together: sums over them need no further shuffle, and spill.
        first = Window.partitionBy("ctx").orderBy("suf")
        every = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        over = lambda c: F.sum(c).over(every)
        share = (F.col("n") - DISCOUNT) / F.col("total")
        met = met.withColumn("place", F.row_number().over(first)).withColumn("share", share).withColumn("left", F.greatest(1.0 - over(share), F.lit(1e-12))).withColumn("base", over(F.col("below")))
        met = met.withColumn("full", F.col("share") + F.col("left") * F.col("below"))
        met = met.withColumn("gain", over(F.col("full") * F.ln(F.col("full") / F.col("below")))).withColumn("all", over(F.col("full")))
        rest, base = 1.0 - F.col("all"), 1.0 - F.col("base")
        kept = F.col("gain") + F.when((rest > 1e-12) & (base > 1e-12), rest * F.ln(rest / base)).otherwise(0.0) >= DIVERGENCE
        met = met.withColumn("kept", kept)
        p = F.when(F.col("kept"), F.col("full")).otherwise(F.col("below"))
        w = F.when(F.col("kept"), F.log10(F.col("full") / F.col("below")) - F.log10("left")).otherwise(0.0)
        cell = F.struct(F.lit(False).alias("state"), "ctx", "suf", "n", p.alias("p"), w.alias("w"), F.lit(None).cast("double").alias("left"), F.lit(None).cast("boolean").alias("kept"))
        own = F.when(F.col("kept"), F.log10("left")).otherwise(0.0)
        state = F.struct(F.lit(True).alias("state"), F.col("ctx").alias("ctx"), F.col("down").alias("suf"), F.col("total").alias("n"), F.lit(0.0).alias("p"), own.alias("w"), F.col("left").alias("left"), F.col("kept").alias("kept"))
        rows = met.select(F.explode(F.when(F.col("place") == 1, F.array(cell, state)).otherwise(F.array(cell))).alias("r")).select("r.*")
        done = stored(rows.mapInArrow(_named, _LEVEL), "level")
        dropped(before)
        _released(done)
        tree.tables.append(done)
        below = done.filter("not state").select("h", "suf", "n", "p")
    return tree, counts


def windows(token: np.ndarray, stops: np.ndarray, first: int) -> list[np.ndarray]:
    """The last MAX_DEPTH + 1 tokens at every place, oldest first. Behind the last one, what would lie before a token that stops is that token again; `first` stands before all."""

    def back(x: np.ndarray, one) -> np.ndarray:
        return np.append(np.array([one], x.dtype), x[:-1])

    out, stop = [back(token, first), token], back(stops, True)
    for _ in range(MAX_DEPTH - 1):
        out.insert(0, np.where(stop, out[0], back(out[0], first)))
        stop = stop | back(stop, True)
    return out


def named(tokens_: list[np.ndarray]) -> np.ndarray:
    """Hash of the gram of these tokens."""
    return tokens_[0] if len(tokens_) == 1 else joined(named(tokens_[:-1]), named(tokens_[1:]))


class Large:
    """Contexts of one length that are too frequent for one task: their names, the mass left to symbols not kept, and whether they are kept."""

    def __init__(self, rows: list[tuple[int, float, bool]]):
        self.rows = rows
        self.index = HashIndex(np.array([r[0] for r in rows], np.int64).view(np.uint64))
        self.left, self.kept = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], bool)


class Model:
    """What the executors know: the most frequent tokens with their counts, the most frequent cells of large contexts with their
    chances, the large contexts, and filters of all other tokens that may be contexts, and of all other tokens and cells that
    occur twice."""

    def __init__(self, token: np.ndarray, count: np.ndarray, cell: np.ndarray, chance: np.ndarray, large: list, often: Filter, twice: Filter, denominator: float, parts: int):
        self.state = token, count, cell, chance, large, often, twice, denominator, parts
        self.token, self.chance, self.often, self.twice, self.denominator, self.parts = token, chance, often, twice, denominator, parts
        self.once = len(token)  # code of a token that surely occurs once or, in a context, too seldom
        self.count = np.append(count, 1.0)
        self.codes, self.cells, self.large = HashIndex(token), HashIndex(cell), [Large(rows) for rows in large]

    def __getstate__(self) -> tuple:
        return self.state

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)  # the indexes are made again where they are used

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(tokens, where rows begin, codes of the tokens (-1: rare), whether a token is too seldom for a context, then of each occurrence the
        hashes of its last tokens, how many of its contexts are large, and its part). All occurrences of a context that is not large share a part."""
        token, begins = tokens(batch)
        code = self.codes(token)
        open_ = np.flatnonzero(code < 0)
        seldom = np.zeros(len(token), bool)
        seldom[open_] = ~self.often(token[open_])
        train = ~(batch.column("held_out").fill_null(True).to_numpy(zero_copy_only=False))
        open_ = open_[np.repeat(train, np.diff(begins))[open_]]
        code[open_[~self.twice(token[open_])]] = self.once
        w = windows(token, token == END, END)
        depth, at = np.zeros(len(token), np.uint8), np.arange(len(token))
        key, own = np.where(np.append(False, seldom[:-1]) & (w[-2] != END), token, w[-2]), w
        for k in range(1, MAX_DEPTH + 1):
            context = named(own[MAX_DEPTH - k : MAX_DEPTH])
            if k > 1:
                key[at] = context
            large = self.large[k - 1].index(context) >= 0
            at, own = at[large], [x[large] for x in own]
            if not len(at):
                break
            depth[at] = k
            key[at] = named(own[MAX_DEPTH - k :])  # no context of this length, or a large one: its cells are spread
            there = own[MAX_DEPTH - k] != END
            at, own = at[there], [x[there] for x in own]
        return token, begins, code, seldom, w, depth, (mix(key ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(self.parts)).astype(np.min_scalar_type(self.parts))


def _large_grams(shared):
    """Counts of the cells of contexts all of whose tokens are large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()

        def given() -> Iterator[pa.RecordBatch]:
            if counter.size:
                h, n, *also = counter.given()
                columns = [pa.array(also[0].astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (h, *also[1:])), pa.array(n.astype(np.int64))]
                whole = pa.RecordBatch.from_arrays(columns, names=["level", "h", "ctx", "suf", "n"])
                yield from (whole.slice(at, _PIECE) for at in range(0, len(n), _PIECE))

        index = HashIndex(shared.value)
        for part in chunks(batches, "text"):
            token = tokens(part)[0]
            own = windows(token, token == END, END)
            for k in range(1, MAX_DEPTH + 1):
                held = index(own[MAX_DEPTH - k]) >= 0
                if k > 1:
                    held &= own[MAX_DEPTH - k + 1] != END
                own = [x[held] for x in own]
                counter.add(named(own[MAX_DEPTH - k :]), np.full(len(own[0]), k), named(own[MAX_DEPTH - k : MAX_DEPTH]), named(own[MAX_DEPTH - k + 1 :]))
            if counter.shrink():
                yield from given()
        yield from given()

    return run


def _large(texts: DataFrame, tree: Tree, parts: int) -> tuple[list[list[tuple[int, float, bool]]], DataFrame | None, list[DataFrame]]:
    """(the large contexts by length, the table h, n, p of their cells, scratch tables to drop). A context is large if it holds more than a mean
    part; there are at most as many of a length as parts."""
    spark = texts.sparkSession
    most = max(_LARGE, tree.total // parts)
    out: list[list[tuple[int, float, bool]]] = [[] for _ in range(MAX_DEPTH)]
    keys = tree.root.filter(F.col("c") > most).select("h").toArrow()["h"].to_numpy().view(np.uint64)
    if not len(keys):
        return out, None, []
    shared = spark.sparkContext.broadcast(keys)
    counted = texts.mapInArrow(_large_grams(shared), "level int, h long, ctx long, suf long, n long").groupBy("level", "h", "ctx", "suf").agg(F.sum("n").alias("n"))
    table = stored(counted, "large")
    shared.destroy()
    totals = table.groupBy("level", "ctx").agg(F.sum("n").alias("total")).filter(F.col("total") > most).collect()
    cells, scratch = None, []
    below = tree.root.select(F.col("h").alias("suf"), ((F.col("c") + 1.0) / F.lit(tree.denominator)).alias("below"))
    for k in range(1, MAX_DEPTH + 1):
        own = [(r["ctx"], r["total"]) for r in totals if r["level"] == k]
        if not own:
            break
        met = table.filter((F.col("level") == k) & (F.col("n") >= MIN_CELL)).join(F.broadcast(spark.createDataFrame(own, "ctx long, total long")), "ctx").join(below, "suf")
        met = stored(met.select("h", "ctx", "n", "below", ((F.col("n") - DISCOUNT) / F.col("total")).alias("share")), "met")
        left = {r["ctx"]: max(1.0 - r["share"], 1e-12) for r in met.groupBy("ctx").agg(F.sum("share").alias("share")).collect()}
        full = met
        if left:
            full = met.join(F.broadcast(spark.createDataFrame(list(left.items()), "ctx long, left double")), "ctx").withColumn("full", F.col("share") + F.col("left") * F.col("below"))
            sums = full.groupBy("ctx").agg(F.sum(F.col("full") * F.ln(F.col("full") / F.col("below"))).alias("gain"), F.sum("full").alias("full"), F.sum("below").alias("below")).collect()
            kept = {r["ctx"] for r in sums if _gained(np.array([r["gain"]]), np.array([r["full"]]), np.array([r["below"]]))[0] >= DIVERGENCE}
            done = stored(full.select("h", "n", F.when(F.col("ctx").isin(list(kept)), F.col("full")).otherwise(F.col("below")).alias("p")), "cells")
            scratch.append(done)
            cells = done if cells is None else cells.unionByName(done)
            below = done.select(F.col("h").alias("suf"), F.col("p").alias("below"))
        dropped(met)
        out[k - 1] = [(c, left.get(c, 1.0), bool(left) and c in kept) for c, _ in own]
        if not left:
            break
    dropped(table)
    for level in range(MAX_DEPTH):  # contexts of which no cell occurs twice are large all the same
        out[level] = out[level] or [(r["ctx"], 1.0, False) for r in totals if r["level"] == level + 1]
    return out, cells, scratch


def _gained(gain: np.ndarray, full: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Divergence of contexts from their suffixes, from the sums over their cells."""
    rest, base = np.maximum(1.0 - full, 0.0), np.maximum(1.0 - below, 0.0)
    both = (rest > 1e-12) & (base > 1e-12)
    return gain + np.where(both, rest * np.log(np.where(both, rest, 1.0) / np.where(both, base, 1.0)), 0.0)


_OCCURRENCES = 1 << 20  # about so many occurrences lie in one part
_PARTS = 128  # parts at least: below that size of a corpus a row's sums come from as many parts at every size
_LARGE = 1 << 14  # a context of fewer occurrences is never large
_SLICES = 1  # passes over the texts in which parts are met: each has its share of the packets
_COPIES = 1000  # rows are given out in batches of so many
_STEP = 1 << 19  # about so many occurrences of a part are looked at together
_DOC = np.dtype([("row", "<u4"), ("doc_id", "<i8"), ("no_id", "?"), ("held_out", "?"), ("n_tokens", "<i8"), ("n_known", "<i8"), ("base", "<f8"), ("sent", "<i8")])
_ZSTD = pa.Codec("zstd", 1)


def _packed(x: np.ndarray) -> bytes:
    """Columns of whole numbers below 2^24, by planes of bytes: equal bytes come together and compress well."""
    return _ZSTD.compress(np.ascontiguousarray(x.view(np.uint8).reshape(*x.shape, 4).transpose(0, 2, 1)[:, :3]), asbytes=True)


def _unpacked(data: bytes, columns: int, n: int) -> np.ndarray:
    out = np.zeros((columns, n, 4), np.uint8)
    out[:, :, :3] = np.frombuffer(_ZSTD.decompress(data, 3 * columns * n), np.uint8).reshape(columns, 3, n).transpose(0, 2, 1)
    return out.view(np.uint32)[:, :, 0]


def _wanted(shared):
    """Rare tokens and cells (h) that the occurrences of a part need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        hashes, parts, held = [], [], 0

        def given() -> Iterator[pa.RecordBatch]:
            h, part = np.concatenate(hashes), np.concatenate(parts).astype(np.int32)
            order = np.lexsort((part, h))
            h, part = h[order], part[order]
            one = np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]))[: len(h)]
            whole = pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(part[one])], names=["h", "part"])
            yield from (whole.slice(at, _PIECE) for at in range(0, whole.num_rows, _PIECE))

        for batch in chunks(batches, "text"):
            _, _, code, _, w, depth, part = model.read(batch)
            for k in range(MAX_DEPTH + 1):
                at = np.flatnonzero(depth >= k) if k else np.flatnonzero(code < 0)
                h = named([x[at] for x in w[MAX_DEPTH - k :]])
                if k:
                    rare = (model.cells(h) < 0) & model.twice(h)
                    at, h = at[rare], h[rare]
                hashes.append(h)
                parts.append(part[at])
                held += len(h)
            if held > _FLUSH:
                yield from given()
                hashes, parts, held = [], [], 0
        if hashes:
            yield from given()

    return run


def _found(shared, parts: int, turn: int, slices: int):
    """Packets of the occurrences by part, of the parts whose number leaves `turn`: `codes` of the last tokens and how many contexts are large,
    `rare` tokens behind the codes from model.once + 1 on, `runs` of occurrences in one row, and `docs`, the rows' records.
    A row is named by its place in a `flush` of rows, which one task reads together in every turn."""

    def packets(flush: int, docs: np.ndarray, row: np.ndarray, token: np.ndarray, code: np.ndarray, seldom: np.ndarray, depth: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        model = shared.value
        open_, ends = code < 0, token == END
        rare, place = np.unique(np.append(token[open_], END), return_inverse=True)
        code[open_] = model.once + 1 + place[:-1]
        end = model.codes(np.array([END]))[0]
        end = model.once + 1 + place[-1] if end < 0 else end
        context = np.where(ends, end, np.where(seldom, model.once, code))
        # A token of code -1 only as a last one may be seldom in contexts, and one that occurs once is always seldom.
        context = windows(context, ends | seldom, end)[:-1]
        sent = np.flatnonzero((context[-1] != model.once) | open_)  # any other occurrence has no context, and its row's record has its count
        docs["row"], docs["sent"] = np.arange(len(docs)), np.bincount(row[sent], minlength=len(docs))
        train = ~(docs["held_out"] | docs["no_id"])
        docs = docs if turn == 0 else docs[:0]
        mine = range(turn, parts, slices)
        if slices > 1:
            sent = sent[part[sent] % slices == turn]
        order = sent[np.argsort(part[sent], kind="stable")]
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        codes, row = np.array([x[order] for x in (*context, code, depth)], np.uint32), row[order]
        for at, k in enumerate(mine):  # records are spread evenly, wherever their occurrences go
            own, rows, records = codes[:, cut[k] : cut[k + 1]], row[cut[k] : cut[k + 1]], docs[at :: len(mine)]
            if not len(rows) and not len(records):
                continue
            begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))[: len(rows)]
            runs = np.array([np.diff(rows[begin], prepend=0), np.diff(np.append(begin, len(rows))), train[rows[begin]]], np.uint32)
            beyond = own[:-1] > model.once
            some, place = np.unique(own[:-1][beyond], return_inverse=True)
            if len(some):
                own = own.copy()
                own[:-1][beyond] = model.once + 1 + place
            columns = [_packed(runs), rare[some.astype(np.int64) - model.once - 1].tobytes(), _packed(own), records.tobytes()]
            numbers = [pa.array([k], pa.int32()), pa.array([flush], pa.int64()), pa.array([len(begin)], pa.int32()), pa.array([len(rows)], pa.int32())]
            yield pa.RecordBatch.from_arrays([*numbers, *(pa.array([x], pa.binary()) for x in columns)], names=["part", "flush", "m", "n", "runs", "rare", "codes", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        flush = TaskContext.get().partitionId() << 32
        docs, held, rows, n = [], [], 0, 0
        unknown = float(-np.log10(model.denominator))
        weight = np.append(np.log10(model.count + 1.0) + unknown, 0.0)
        for batch in chunks(batches, "text"):
            token, begins, code, seldom, _, depth, part = model.read(batch)
            size = np.diff(begins)
            row = np.repeat(np.arange(len(size)), size)
            doc = np.zeros(len(size), _DOC)
            doc["doc_id"] = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            doc["no_id"] = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc["held_out"] = batch.column("held_out").fill_null(False).to_numpy(zero_copy_only=False)
            doc["n_tokens"], doc["n_known"], doc["base"] = size, np.bincount(row[code >= 0], minlength=len(size)), np.bincount(row, weight[code], len(size))
            docs.append(doc)
            held.append((row + rows, token, code.astype(np.int32), seldom, depth, part))
            rows += len(doc)
            n += len(token) + len(doc)
            if n > _FLUSH:
                yield from packets(flush, np.concatenate(docs), *(np.concatenate(x) for x in zip(*held, strict=True)))
                docs, held, rows, n, flush = [], [], 0, 0, flush + 1
        if docs:
            yield from packets(flush, np.concatenate(docs), *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _coded(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(numbers of equal values, how many), numbered as they first occur."""
    out = pa.array(x).dictionary_encode()
    return out.indices.to_numpy(), len(out.dictionary)


def _chances(w: np.ndarray, train: np.ndarray, depth: np.ndarray, p: np.ndarray, end: int, seldom: int, size: int, met) -> np.ndarray:
    """Chance of each occurrence's last token in its longest retained context. p: by the root; depth: how many of its contexts are large,
    for which met(level, places, p) answers; every other context has all its occurrences here, and its state is made from them.
    end, seldom: codes of END and of tokens that no state's context holds; size: all codes lie below."""
    at, ids = np.arange(len(p)), np.zeros(len(p), np.int64)
    twice = w[MAX_DEPTH] != seldom  # the cell of the shorter context occurs often enough
    for k in range(1, MAX_DEPTH + 1):
        there = w[MAX_DEPTH - k, at] != seldom
        if k > 1:
            there &= w[MAX_DEPTH - k + 1, at] != end
        at, ids = at[there], ids[there]
        ids, n = _coded(ids * size + w[MAX_DEPTH - k, at])
        ids = ids.astype(np.int64)
        total = np.bincount(ids, train[at], n)
        large = depth[at] >= k
        held = large | (total[ids] >= MIN_CONTEXT)
        at, ids, large = at[held], ids[held], large[held]
        own = np.flatnonzero(~large)
        if large.any():
            where = at[large]
            p[where] = met(k, where, p[where])
        some = own[twice[at[own]]]
        cells, m = _coded(ids[some] * size + w[MAX_DEPTH, at[some]])
        count = np.bincount(cells, train[at[some]], m)
        first = np.zeros(m, np.int64)
        first[cells[::-1]] = some[::-1]
        often = count >= MIN_CELL
        context, below = ids[first[often]], p[at[first[often]]]
        share = (count[often] - DISCOUNT) / total[context]
        left = np.maximum(1.0 - np.bincount(context, share, n), 1e-12)
        full = share + left[context] * below
        sums = (np.bincount(context, x, n) for x in (full * np.log(full / below), full, below))
        kept = (_gained(*sums) >= DIVERGENCE) & (np.bincount(context, minlength=n) > 0)
        p[at[own]] *= np.where(kept, left, 1.0)[ids[own]]
        chance = np.zeros(m)
        chance[often] = np.where(kept[context], full, below)
        inside = often[cells]
        p[at[some[inside]]] = chance[cells[inside]]
        twice[at[own]] = False
        twice[at[some[inside]]] = True
    return p


def _sums(shared):
    """From the packets of one part, and the rare tokens and cells that it needs: for each packet its rows' sums."""

    def run(key: tuple, found: pa.Table, known: pa.Table) -> pa.Table:
        model = shared.value
        m, sizes = found["m"].to_pylist(), found["n"].to_pylist()
        rare = [np.frombuffer(x.as_py(), np.uint64) for x in found["rare"]]
        some, place = np.unique(np.concatenate([np.array([END]), *rare]), return_inverse=True)
        codes = np.zeros((MAX_DEPTH + 2, sum(sizes)), np.int32)
        at, seen, beyond = 0, 1, model.once + 1
        for x, own, n in zip(found["codes"], rare, sizes, strict=True):
            part = _unpacked(x.as_py(), MAX_DEPTH + 2, n).astype(np.int32)
            again = part[:-1] >= beyond
            part[:-1][again] = beyond + place[seen - beyond + part[:-1][again]]
            codes[:, at : at + n] = part
            at, seen = at + n, seen + len(own)
        runs = np.concatenate([np.zeros((3, 0), np.uint32), *(_unpacked(x.as_py(), 3, k) for x, k in zip(found["runs"], m, strict=True))], axis=1)
        doc = np.repeat(np.arange(runs.shape[1], dtype=np.int32), runs[1])
        h = known["h"].to_numpy().astype(np.int64).view(np.uint64)
        c, chance = (known[k].to_numpy().astype(float) for k in ("c", "p"))
        root = ~np.isnan(c)
        own = HashIndex(h[root])(some)
        hashes = np.concatenate([model.token, [~END], some])  # a token that occurs once is in no cell
        count = np.append(model.count, np.where(own >= 0, np.append(c[root], 0.0)[own], 0.0))
        end = model.codes(np.array([END]))[0]
        end = beyond + place[0] if end < 0 else end
        rest, rest_chance, common = HashIndex(h[~root]), np.append(chance[~root], 0.0), np.append(model.chance, 0.0)
        n_known, base, gain = np.zeros(len(runs[0])), np.zeros(len(runs[0])), np.zeros(len(runs[0]))
        # Occurrences with one last token but one are looked at together: all of a context, and some others.
        steps = max(1, sum(sizes) // _STEP)
        step = (mix(codes[MAX_DEPTH - 1].astype(np.uint64)) % np.uint64(steps)).astype(np.min_scalar_type(steps))
        order = np.argsort(step, kind="stable")
        cut = np.searchsorted(step[order], np.arange(steps + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = codes[:, order[a:b]]
            w, of = own[:-1], doc[order[a:b]]

            def met(k: int, where: np.ndarray, p: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                tokens_ = [hashes[w[j, where]] for j in range(MAX_DEPTH - k, MAX_DEPTH + 1)]
                large = model.large[k - 1]
                at = large.index(named(tokens_[:-1]))
                out = np.where(large.kept[at], large.left[at], 1.0) * p
                cell = named(tokens_)
                for index, value in ((model.cells, common), (rest, rest_chance)):
                    held = index(cell)
                    out = np.where(held >= 0, value[held], out)
                return out

            n = count[w[MAX_DEPTH]]
            p = (n + 1.0) / model.denominator
            rooted = np.log10(p)
            fresh = np.flatnonzero(w[MAX_DEPTH] >= beyond)  # what the row's record does not have
            n_known += np.bincount(of[fresh], n[fresh] > 0, len(gain))
            base += np.bincount(of[fresh], rooted[fresh], len(gain))
            gain += np.bincount(of, np.log10(_chances(w, runs[2][of].astype(float), own[-1], p, end, model.once, len(hashes), met)) - rooted, len(gain))
        out, at = [], 0
        for k in m:
            some = np.flatnonzero(base[at : at + k])
            out.append((gain[at : at + k].tobytes(), np.array([some, n_known[at + some], base[at + some]], float).tobytes()))
            at += k
        gains, bases = (pa.array([x[j] for x in out], pa.binary()) for j in (0, 1))
        return pa.table([found["flush"], found["m"], found["runs"], gains, bases, found["docs"]], names=["flush", "m", "runs", "gains", "bases", "docs"])

    return run


_SUMS = "flush long, m int, runs binary, gains binary, bases binary, docs binary"


def _rows(key: tuple, sums: pa.Table) -> pa.Table:
    """The rows of one flush."""
    docs = np.frombuffer(b"".join(x.as_py() for x in sums["docs"]), _DOC)
    docs = docs[np.argsort(docs["row"])]
    sent, n_known, base, gain = (np.zeros(len(docs)) for _ in range(4))
    for m, runs, gains, bases in zip(sums["m"].to_pylist(), sums["runs"], sums["gains"], sums["bases"], strict=True):
        row, n, _ = _unpacked(runs.as_py(), 3, m)
        row = np.cumsum(row, dtype=np.int64)  # each once
        sent[row] += n
        gain[row] += np.frombuffer(gains.as_py(), float)
        some, known, of_base = np.frombuffer(bases.as_py(), float).reshape(3, -1)
        some = row[some.astype(np.int64)]
        n_known[some] += known
        base[some] += of_base
    if (sent != docs["sent"]).any() or (docs["row"] != np.arange(len(docs))).any():
        raise RuntimeError("a task that was repeated has read its rows in another order; store the table first")
    base += docs["base"]
    out = {
        "doc_id": pa.array(docs["doc_id"], pa.int64(), mask=docs["no_id"]),
        "held_out": pa.array(docs["held_out"], pa.bool_(), mask=docs["no_id"]),
        "n_tokens": pa.array(docs["n_tokens"], pa.int64()),
        "n_known": pa.array(docs["n_known"] + np.rint(n_known).astype(np.int64), pa.int64()),
        "base_score": pa.array(base),
        "score": pa.array(base + gain),
    }
    return pa.Table.from_batches(pa.table(out).to_batches(max_chunksize=_COPIES))


_ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    bounded_batches(docs)
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out_of())
    texts = rows.filter("not held_out").select("text")
    tree = counted(texts)
    parts = max(_PARTS, -(-tree.total // _OCCURRENCES))
    large, cells, scratch = _large(texts, tree, parts)
    table = tree.root.select("h", "c", F.lit(None).cast("double").alias("p"), F.col("c").alias("n"))
    if cells is not None:
        table = table.unionByName(cells.select("h", F.lit(None).cast("long").alias("c"), "p", "n"))
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    frequent = F.lit(False)
    left = HEAVY
    for row in sorted(table.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # a few hundred rows at most
        left -= row["count"]
        if left < 0:
            break
        frequent = step >= row["step"]
    heavy, rare = table.filter(frequent).toArrow().sort_by([("n", "descending"), ("h", "ascending")]), table.filter(~frequent)
    is_token = heavy["c"].is_valid().to_numpy()
    h, c, p = heavy["h"].to_numpy().view(np.uint64), heavy["c"].to_numpy().astype(float), heavy["p"].to_numpy().astype(float)
    often, twice = filter_of(rare.filter(F.col("c") >= MIN_CONTEXT).select("h")), filter_of(rare.filter(F.col("n") >= MIN_CELL).select("h"))
    rare = rare.select("h", "c", "p")
    shared = spark.sparkContext.broadcast(Model(h[is_token], c[is_token], h[~is_token], p[~is_token], large, often, twice, tree.denominator, parts))
    if left < 0:
        known = rows.mapInArrow(_wanted(shared), "h long, part int").distinct().join(rare, "h").select("part", "h", "c", "p")
    else:
        known = spark.createDataFrame([], "part int, h long, c long, p double")
    _released(table)
    met = None
    for turn in range(_SLICES):
        found = rows.mapInArrow(_found(shared, parts, turn, _SLICES), "part int, flush long, m int, n int, runs binary, rare binary, codes binary, docs binary").groupBy("part")
        own = known.filter(F.col("part") % _SLICES == turn).groupBy("part")
        part = stored(found.cogroup(own).applyInArrow(_sums(shared), _SUMS), "sums")
        _released(part)
        met = part if met is None else met.unionByName(part)
    shared.destroy()
    for done in (tree.root, *scratch):
        dropped(done)
    out = met.groupBy("flush").applyInArrow(_rows, _ROWS)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
