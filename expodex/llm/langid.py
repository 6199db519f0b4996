"""Language identification with language-bitmask n-gram filters.

Each language has a Bloom filter of its characteristic byte n-grams. The filters are bit-sliced:
slot s holds one mask whose bit l says whether language l's filter has bit s set, so the AND of the
HASHES slots of an n-gram is the set of all languages that contain it. A text's n-grams are counted
per language by the popcounts of these masks; a language whose filter is set to the share f wrongly
contains f**HASHES of all n-grams, and its count c of n is corrected to (c - n*p) / (1 - p). The
language with the highest corrected count is the prediction, its share of all corrected counts the
score.

Learning uses a bounded sample of labelled rows: SAMPLE rows of each language on average, those of
smallest hash of (doc_id, text length). An n-gram of length n is a language's own if it makes up at
least MIN_SHARE of that language's n-grams (so a filter has at most 1 / MIN_SHARE entries of each
length) and at least OWN_SHARE of the highest share that any language gives it.

Defined results: null texts and texts without any letter are `und` with score 0; so is every text
if nothing could be learned; ties go to the alphabetically first language; repeated rows are judged
alike; rows with a null lang or doc_id teach nothing (a null doc_id has held_out null); long texts
are read whole; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bounded_batches, chunks, flat_bytes, mix

#: Bytes of text that are looked at together: n-grams take about fifty times as much.
CHUNK = CHUNK_BYTES // 4
LENGTHS = (3, 5)
HASHES = 3
SLOT_BITS = 22
SAMPLE = 4000
MIN_SHARE = 4e-6
OWN_SHARE = 0.2
#: A text is rejected by accepted() if fewer of its n-grams than this share are its language's own.
LEAST_KNOWN = 0.15

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CLEAN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)
_CLEAN[65:91] += 32


def grams(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all n-grams inside words; a word is a run of letters with a blank at both ends."""
    n = len(flat)
    rows = len(offsets) - 1
    padded = np.full(n + 2 * rows, 32, np.uint8)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    padded[np.arange(n) + 2 * owner + 1] = _CLEAN[flat]
    owner = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    blank = padded == 32
    out_row, out_code = [], []
    for length in LENGTHS:
        m = len(padded) - length + 1
        if m <= 0:
            continue
        code = np.full(m, length, np.uint64)
        inner = np.zeros(m, bool)
        for k in range(length):
            code = (code << np.uint64(8)) | padded[k : k + m]
            if 0 < k < length - 1:
                inner |= blank[k : k + m]
        at = np.flatnonzero(~inner)
        if length == min(LENGTHS):  # a gram of a single letter counts, one of blanks alone does not
            at = at[~(blank[at] & blank[at + 1])]
        out_row.append(owner[at])
        out_code.append(code[at])
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_code)


def _slots(code: np.ndarray) -> list[np.ndarray]:
    h = mix(code)
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(21 * k)) & mask).astype(np.int64) for k in range(HASHES)]


class Filters:
    """Bit-sliced Bloom filters; entries: language -> array of n-gram codes."""

    def __init__(self, entries: dict[str, np.ndarray]):
        self.languages = sorted(entries)
        self.width = -(-len(self.languages) // 64) or 1
        kind = next(t for bits, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (10**9, np.uint64)) if len(self.languages) <= bits)
        self.slots = [np.zeros(1 << SLOT_BITS, kind) for _ in range(self.width)]
        self.wrong = np.zeros(len(self.languages))
        for k, name in enumerate(self.languages):
            for at in _slots(entries[name]):
                self.slots[k // 64][at] |= kind(1 << (k % 64))
        for k in range(len(self.languages)):
            share = np.count_nonzero(self.slots[k // 64] & kind(1 << (k % 64))) / (1 << SLOT_BITS)
            self.wrong[k] = share**HASHES

    def counts(self, rows: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each row, corrected counts of each row and language)."""
        total = np.bincount(rows, minlength=n).astype(float)
        found = np.zeros((n, len(self.languages)))
        places = _slots(code)
        for w, slots in enumerate(self.slots):
            mask = slots[places[0]]
            for at in places[1:]:
                mask &= slots[at]
            own = range(64 * w, min(64 * (w + 1), len(self.languages)))
            if mask.dtype == np.uint8:
                table = np.bincount(rows * 256 + mask, minlength=n * 256).reshape(n, 256)
                for k in own:
                    found[:, k] = table[:, (np.arange(256) >> k) & 1 == 1].sum(axis=1)
            else:
                for k in own:
                    found[:, k] = np.bincount(rows[(mask >> mask.dtype.type(k % 64)) & 1 == 1], minlength=n)
        return total, np.maximum(0.0, (found - total[:, None] * self.wrong) / (1 - self.wrong))

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, share of the n-grams that are that language's) of each text."""
        flat, offsets = flat_bytes(column)
        n = len(column)
        total, counts = self.counts(*grams(flat, offsets), n)
        plain = np.zeros(256, bool)
        plain[65:91] = plain[97:123] = True
        ascii_letters = np.concatenate([[0], np.cumsum(plain[flat])])
        lettered = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        for k in np.flatnonzero(~lettered & (np.diff(offsets) > 0)).tolist():
            lettered[k] = any(c.isalpha() for c in column[k].as_py() or "")
        if not self.languages:
            return ["und"] * n, np.zeros(n), np.zeros(n)
        best = counts.argmax(axis=1)
        top = counts[np.arange(n), best]
        every = counts.sum(axis=1)
        score = np.where(lettered & (every > 0), top / np.maximum(every, 1e-300), 0.0)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.clip(score, 0, 1), np.where(total > 0, np.minimum(1, top / np.maximum(total, 1)), 0.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", CHUNK):
        langs = np.array(batch.column("lang").to_pylist(), object)
        rows, code = grams(*flat_bytes(batch.column("text")))
        for lang in sorted(set(langs.tolist())):
            own, n = np.unique(code[(langs == lang)[rows]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def learned(labelled: DataFrame) -> Filters:
    """Filters from rows (doc_id, text, lang), sampled as the module says."""
    bounded_batches(labelled)
    rows = labelled.select("doc_id", "text", "lang").filter("lang is not null and text is not null and doc_id is not null")
    sizes = rows.groupBy("lang").count().withColumn("keep", F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("count")))
    place = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.join(F.broadcast(sizes), "lang").filter(place < F.col("keep")).select("lang", "text")
    counts = drawn.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("length", F.when(F.col("code") < (1 << 32), F.lit(LENGTHS[0])).otherwise(F.lit(LENGTHS[-1])))
    totals = counts.groupBy("lang", "length").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["lang", "length"]).withColumn("share", F.col("n") / F.col("total"))
    shares = shares.filter((F.col("share") >= MIN_SHARE)).select("lang", "code", "share").toArrow().to_pandas()
    if not len(shares):
        return Filters({})
    own = shares["share"] >= OWN_SHARE * shares.groupby("code")["share"].transform("max")
    return Filters({str(k): g["code"].to_numpy().astype(np.int64).view(np.uint64) for k, g in shares[own].groupby("lang")})


def held_out_of(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def _filters(spark, labelled: DataFrame):
    return spark.sparkContext.broadcast(learned(labelled))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out_of())
    shared = _filters(docs.sparkSession, rows.filter("not held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            names, score, _ = shared.value.judge(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, least_known: float = LEAST_KNOWN) -> DataFrame:
    """The rows of docs, with all columns, whose text is in a learned language; und and unknown text goes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    shared = _filters(docs.sparkSession, rows.filter(~held_out_of()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            names, _, known = shared.value.judge(batch.column("text"))
            yield batch.filter(pa.array([n != "und" and k >= least_known for n, k in zip(names, known.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
