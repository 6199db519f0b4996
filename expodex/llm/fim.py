"""Fill-in-the-middle transformation by overlapping-chunk decomposition.

The bytes of a text are cut into chunks of CHUNK bytes, each seen with the one byte that follows it.
A predicate on two adjacent bytes says where a unit ends, so every chunk counts its unit ends without
its neighbours, all at once; prefix sums over the counts give every text's number of units and name
the chunk that owns each of its two cuts; only those chunks are read again to find the cuts.

The cut texts come back as prefix, middle and suffix; form, output and the way back are Column
expressions. One narrow pass, nothing is shuffled.

Defined results: a null text is an empty one (no units, plain, empty output); a text that holds a
sentinel is plain; a null doc_id draws as the text `null`; repeated rows are cut alike, as often as
they occur; very long texts are cut whole; an empty table gives an empty result; further columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, bounded_batches, chunks, flat_bytes

CHUNK = 4096
#: Bytes that are looked at at once.
SPAN = 1 << 20
SENTINELS = ("<P>", "<S>", "<M>")

Ends = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Whether a unit ends between a byte and the next: after a line feed; before a word's first byte; before any character.
UNITS: dict[str, Ends] = {
    "line": lambda here, following: here == 10,
    "word": lambda here, following: ~SPACED[here] & SPACED[following],
    "char": lambda here, following: (following & 0xC0) != 0x80,
}


def cuts(flat: np.ndarray, offsets: np.ndarray, draws: np.ndarray, ends: Ends, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(units of each text, places of its cuts): texts are flat[offsets[k]:offsets[k + 1]], draws has a row a text.

    A draw h of a text with n units cuts after its first h mod (n + 1) units; cuts are in rising order.
    """
    padded = np.append(flat, np.uint8(0))
    pieces = -(-np.diff(offsets) // chunk)
    first = np.concatenate([[0], np.cumsum(pieces)])
    owner = np.repeat(np.arange(len(pieces)), pieces)
    start = offsets[owner] + (np.arange(first[-1]) - first[owner]) * chunk
    stop = np.minimum(start + chunk, offsets[owner + 1])
    closes = stop == offsets[owner + 1]  # the text's last byte ends a unit, whatever follows

    counts = np.zeros(len(start), np.int64)
    step = max(1, SPAN // chunk)
    for a in range(0, len(start), step):
        b = min(a + step, len(start))
        low, high = start[a], stop[b - 1]
        flags = ends(padded[low:high], padded[low + 1 : high + 1])
        flags[stop[a:b][closes[a:b]] - 1 - low] = True
        counts[a:b] = np.add.reduceat(flags, start[a:b] - low, dtype=np.int64)
    until = np.concatenate([[0], np.cumsum(counts)])
    units = until[first[1:]] - until[first[:-1]]

    ranks = np.sort(draws % (units[:, None] + 1), axis=1)
    places = np.repeat(offsets[:-1, None], ranks.shape[1], axis=1)
    places[ranks == units[:, None]] = np.repeat(offsets[1:, None], ranks.shape[1], axis=1)[ranks == units[:, None]]
    inner = np.flatnonzero((ranks > 0) & (ranks < units[:, None]))
    wanted = ranks.ravel()[inner] + until[first[inner // ranks.shape[1]]]
    chunk_of = np.searchsorted(until[1:], wanted)
    for a in range(0, len(inner), step):
        c = chunk_of[a : a + step]
        size = stop[c] - start[c]
        base = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(base[-1]) + np.repeat(start[c] - base[:-1], size)
        flags = ends(padded[at], padded[at + 1])
        flags[base[1:][closes[c]] - 1] = True
        seen = np.concatenate([[0], np.cumsum(flags)])
        found = np.searchsorted(seen[1:], seen[base[:-1]] + wanted[a : a + step] - until[c])
        places.ravel()[inner[a : a + step]] = at[found] + 1
    return units, places


def _cut(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            flat, offsets = flat_bytes(batch.column("text"))
            draws = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
            units, places = cuts(flat, offsets, draws, UNITS[unit])
            # The three parts of every text tile the bytes of the batch.
            bounds = np.append(np.concatenate([offsets[:-1, None], places], axis=1).ravel(), offsets[-1])
            parts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat)))
            each = [parts.take(pa.array(np.arange(k, len(parts), 3))).cast(pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(units), *each], names=["doc_id", "n", "prefix", "middle", "suffix"])

    return run


def draw(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th (from 1) number of a doc_id: eight hex digits of a digest, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix, middle, suffix, output for every row of docs.

    rate: percentage of texts that are transformed; spm: of these, the percentage with the suffix first;
    unit: line, word or char; sentinels: what comes before prefix, suffix and middle.
    """
    bounded_batches(docs)
    number = F.col("doc_id").cast("long")
    rows = docs.select(number.alias("doc_id"), "text", draw(number, seed, 1).alias("h1"), draw(number, seed, 2).alias("h2"))
    cut = rows.mapInArrow(_cut(unit), "doc_id long, n long, prefix string, middle string, suffix string")
    p, s, m = (F.lit(x) for x in sentinels)
    whole = F.concat("prefix", "middle", "suffix")
    held = whole.contains(sentinels[0]) | whole.contains(sentinels[1]) | whole.contains(sentinels[2])
    plain = (F.col("n") == 0) | held | (draw(F.col("doc_id"), seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col("doc_id"), seed, 4) % 100 < spm, "spm").otherwise("psm")
    out = cut.withColumn("form", form)
    psm = F.concat(p, F.col("prefix"), s, F.col("suffix"), m, F.col("middle"))
    first = F.concat(s, F.col("suffix"), p, F.col("prefix"), m, F.col("middle"))
    return out.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", first).otherwise(whole).alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of transformed() was made of, from output and form alone.

    No transformed text holds a sentinel, and none can arise where parts meet, so the three that are found are those put in.
    """
    pattern = "|".join("\\Q" + x + "\\E" for x in sentinels)
    parts = F.split(output, pattern, -1)
    one, two, middle = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every row of docs."""
    made = F.col("form") != "plain"
    return transformed(docs).select(
        "doc_id", "n", "form", F.when(made, F.length("prefix").cast("long")).alias("prefix_chars"), F.when(made, F.length("middle").cast("long")).alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
