"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts become sequences of word numbers. A SHIFT table over hashed blocks of two words tells how far
the cursor may jump; where it says 0, a HASH table over the window's last block selects the
patterns to test, and a direct comparison of the words' bytes confirms each occurrence. All
documents of a chunk are searched in lockstep: every stretch of words has its own cursor, and numpy
moves all cursors at once.

Patterns are grouped by their length (ten words, or fewer for short items), because the shortest
pattern bounds every jump. They are held in blocks of at most PATTERNS_PER_BLOCK; a task holds at most
BLOCKS_AT_ONCE of them, and with more it builds one after the other for each large chunk of texts, so
its memory is bounded whatever the number of patterns.

Defined results: a null or wordless text has n_words 0, no hits and the digest of the empty list; a
null or wordless item has no windows; a null item_id is left out; repeated rows of a table each
count (documents) or count once (items, by item_id); empty tables give empty or clean results;
further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, HashIndex, bounded_batches, chunks, flat_bytes, words

WIDTH = 10
STRETCH = 64
PATTERNS_PER_BLOCK = 200_000
#: Matchers that a task holds at once; beyond them each is built for a large chunk of texts, then let go.
BLOCKS_AT_ONCE, LARGE_CHUNK = 4, 64 << 20
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


class WuManber:
    """Finds all patterns, tuples of `length` word numbers (from 1; 0 stands for any other word)."""

    def __init__(self, patterns: list[tuple[int, ...]], length: int):
        self.length, self.block = length, min(2, length)
        self.patterns = np.array(patterns, np.int64).reshape(len(patterns), length)
        self.bits = max(12, int(len(patterns) * length * 4).bit_length())
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.int32)
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, self._slot(self.patterns[:, end - self.block : end]), length - end)
        suffix = self._slot(self.patterns[:, length - self.block :])
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1))

    def _slot(self, block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = block[:, 0].astype(np.uint64) * _A
            if self.block == 2:
                h = (h ^ (h >> np.uint64(29))) + block[:, 1].astype(np.uint64) * _B
                h = (h ^ (h >> np.uint64(31))) * _A
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, pattern) of all occurrences; first: where each row's words begin [+1]."""
        m = self.length
        sizes = np.diff(first) - m + 1  # windows of a row
        rows = np.flatnonzero(sizes > 0)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = -(-sizes[rows] // STRETCH)
        row = np.repeat(rows, parts)
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = first[row] + part * STRETCH + m - 1  # the window's last word
        stop = np.minimum(first[row] + (part + 1) * STRETCH, first[row + 1] - m + 1) + m - 1
        places, found = [], []
        while len(at):
            block = ids[at][:, None] if self.block == 1 else np.stack([ids[at - 1], ids[at]], 1)
            slot = self._slot(block)
            jump = self.shift[slot]
            zero = np.flatnonzero(jump == 0)
            if len(zero):
                lo, hi = self.bucket[slot[zero]], self.bucket[slot[zero] + 1]
                while len(zero):
                    going = lo < hi
                    zero, lo, hi = zero[going], lo[going], hi[going]
                    if not len(zero):
                        break
                    pattern = self.order[lo]
                    same = np.ones(len(zero), bool)
                    for k in range(m):
                        same &= ids[at[zero] - m + 1 + k] == self.patterns[pattern, k]
                    places.append(at[zero[same]] - m + 1)
                    found.append(pattern[same])
                    lo = lo + 1
            at = at + np.maximum(jump, 1)
            alive = at < stop
            if not alive.all():
                at, stop = at[alive], stop[alive]
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Windows:
    """A block of patterns with its vocabulary, one matcher for each length."""

    def __init__(self, patterns: list[tuple[bytes, ...]], owners: list[list[str]]):
        self.vocabulary = sorted({w for p in patterns for w in p})
        number = {w: k + 1 for k, w in enumerate(self.vocabulary)}
        joined = b" ".join(self.vocabulary)
        flat = np.frombuffer(joined, np.uint8)
        self.index = HashIndex(words(flat, np.array([0, len(flat)]), ALNUM)[2])
        by_length: dict[int, list[int]] = defaultdict(list)
        for k, p in enumerate(patterns):
            by_length[len(p)].append(k)
        self.matchers = [(WuManber([tuple(number[w] for w in patterns[k]) for k in own], n), own) for n, own in by_length.items()]
        self.texts = [b" ".join(p) for p in patterns]
        self.owners = owners

    def find(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words, items) of every occurrence, confirmed byte by byte."""
        ids = self.index(hashed) + 1
        for matcher, own in self.matchers:
            for place, k in zip(*(x.tolist() for x in matcher.find(ids, first)), strict=True):
                pattern = own[k]
                n = matcher.length
                text = b" ".join(flat[starts[w] : ends[w]].tobytes() for w in range(place, place + n)).lower()
                if text == self.texts[pattern]:
                    yield place, n, self.owners[pattern]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        item, window = [], []
        flat, offsets = flat_bytes(batch.column("text"))
        starts, ends, _, first = words(flat, offsets, ALNUM)
        for name, a, b in zip(batch.column("item_id").to_pylist(), first[:-1], first[1:], strict=True):
            own = [flat[s:e].tobytes().lower() for s, e in zip(starts[a:b], ends[a:b], strict=True)]
            for k in range(max(1, len(own) - WIDTH + 1) if own else 0):
                item.append(name)
                window.append(b" ".join(own[k : k + WIDTH]))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(window, pa.binary())], names=["item_id", "window"])


def windows_of(items: DataFrame) -> DataFrame:
    """(window, item_ids): the distinct windows with the sorted ids of the items that hold them."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    return rows.mapInArrow(_item_words, "item_id string, window binary").groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def matchers(items: DataFrame) -> list:
    """The windows in blocks of PATTERNS_PER_BLOCK at most, each broadcast by itself."""
    bounded_batches(items)
    spark = items.sparkSession
    blocks, patterns, owners = [], [], []
    for row in windows_of(items).toLocalIterator():
        patterns.append(tuple(bytes(row["window"]).split(b" ")))
        owners.append(list(row["item_ids"]))
        if len(patterns) == PATTERNS_PER_BLOCK:
            blocks.append(spark.sparkContext.broadcast((patterns, owners)))
            patterns, owners = [], []
    if patterns:
        blocks.append(spark.sparkContext.broadcast((patterns, owners)))
    return blocks


class Searched:
    """Chunks of texts with the matchers to search them by."""

    def __init__(self, blocks: list):
        self.blocks = blocks
        self.built = [Windows(*b.value) for b in blocks] if len(blocks) <= BLOCKS_AT_ONCE else None

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunks(batches, "text") if self.built is not None else chunks(batches, "text", LARGE_CHUNK)

    def __iter__(self) -> Iterator[Windows]:
        if self.built is not None:
            yield from self.built
            return
        for b in self.blocks:
            yield Windows(*b.value)
            b.__dict__.pop("_value", None)  # let it go; a worker reads it from its file again when it is needed


def _hits(batch: pa.RecordBatch, built: Searched) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Words, hit words and items of each row."""
    flat, offsets = flat_bytes(batch.column("text"))
    starts, ends, hashed, first = words(flat, offsets, ALNUM)
    mark = np.zeros(len(starts) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(batch.num_rows)]
    places: list[tuple[int, list[str]]] = []
    for block in built:
        for place, n, owners in block.find(flat, starts, ends, hashed, first):
            mark[place] += 1
            mark[place + n] -= 1
            places.append((place, owners))
    if places:
        rows = np.searchsorted(first, np.array([p for p, _ in places]), "right") - 1
        for row, (_, owners) in zip(rows.tolist(), places, strict=True):
            items[row].update(owners)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
    return np.diff(first), hit[first[1:]] - hit[first[:-1]], items


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    blocks = matchers(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = Searched(blocks)
        for batch in built.chunks(batches):
            n_words, n_hit, found = _hits(batch, built)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in found], pa.int64()), pa.array([digest(x) for x in found], pa.string()), pa.array(n_hit > 0)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without any hit, with all their columns."""
    blocks = matchers(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = Searched(blocks)
        for batch in built.chunks(batches):
            yield batch.filter(pa.array(_hits(batch, built)[1] == 0))

    return docs.mapInArrow(run, docs.schema)
