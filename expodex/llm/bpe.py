"""Byte-level BPE encoding and decoding on length-bucketed, padded numpy matrices.

Each match of the split pattern is encoded by itself. Matches of similar length share a padded
matrix of token numbers; in every round each row merges its leftmost pair of minimum rank, ranks
come from a hashed pair table, finished rows leave and the rest are compacted. Matches longer than
LONGEST bytes are one-row matrices: there a round merges all occurrences of the minimum-rank pair
at once where that provably equals merging them one after the other, else only the leftmost.

Worker processes keep a bounded table of the matches they have encoded (CACHE entries, then begun
anew), which only saves time.

Defined results: null and empty texts have no tokens (n_tokens 0, digests of nothing); repeated
rows are encoded as often as they occur; very long texts and matches are encoded whole; null
doc_ids pass through; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashIndex, bounded_batches, chunks

LONGEST = 48
CELLS = 1 << 18
CACHE = 250_000
_NONE = np.int32(2**31 - 1)


class ByteBPE:
    """ranks: the text of a rank file, a base64 token and its rank on each line."""

    def __init__(self, ranks: bytes, pattern: str):
        tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.split = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in tokens.items()}
        self.byte_ids = np.full(256, -1, np.int64)
        for b in range(256):
            self.byte_ids[b] = tokens.get(bytes([b]), -1)
        pairs, merged = [], []
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                left, right = tokens.get(token[:cut]), tokens.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        self.pairs = HashIndex(np.array(pairs, np.uint64), mixed=False)
        self.merged = np.append(np.array(merged, np.int32), _NONE)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is none or a side is padding (-1)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = self.merged[self.pairs((left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF)))]
        out[(left < 0) | (right < 0)] = _NONE
        return out.reshape(shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token numbers of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            least = sizes[order[at]]
            if least > LONGEST:
                for k in order[at:]:
                    out[k] = self._long(self.byte_ids[np.frombuffer(pieces[k], np.uint8)])
                break
            widest = min(LONGEST, int(least * 5 // 4))  # a bucket's rows differ by a quarter in length at most
            to = min(int(np.searchsorted(sizes[order], widest, "right")), at + max(1, CELLS // widest))
            self._bucket(order[at:to], pieces, sizes, out)
            at = to
        return out

    def _bucket(self, rows: np.ndarray, pieces: list[bytes], sizes: np.ndarray, out: list[np.ndarray]) -> None:
        width = int(sizes[rows[-1]])
        flat = self.byte_ids[np.frombuffer(b"".join([pieces[k] for k in rows.tolist()]), np.uint8)]
        held = np.arange(width) < sizes[rows][:, None]
        ids = np.full((len(rows), width), -1, np.int64)
        ids[held] = flat
        size = sizes[rows].copy()
        ranks = self.rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(rows), 0), _NONE, np.int32)
        while len(rows):
            if ids.shape[1] > 1:
                place = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), place]
            else:
                place, best = np.zeros(len(rows), np.int64), np.full(len(rows), _NONE, np.int32)
            done = best == _NONE
            if done.any():
                for k, own, n in zip(rows[done].tolist(), ids[done], size[done].tolist(), strict=True):
                    out[k] = own[:n].copy()
                going = ~done
                rows, ids, ranks, size, place, best = rows[going], ids[going], ranks[going], size[going], place[going], best[going]
                if not len(rows):
                    return
            n, w = ids.shape
            here = np.arange(n)
            taken = np.arange(w - 1) + (np.arange(w - 1) > place[:, None])
            ids = np.take_along_axis(ids, taken, 1)
            ids[here, place] = best
            size = size - 1
            ranks = np.take_along_axis(ranks, taken[:, : w - 2], 1)
            if w > 2:
                left = np.flatnonzero(place > 0)
                ranks[left, place[left] - 1] = self.rank(ids[left, place[left] - 1], ids[left, place[left]])
                right = np.flatnonzero(place < w - 2)
                ranks[right, place[right]] = self.rank(ids[right, place[right]], ids[right, place[right] + 1])

    def _long(self, ids: np.ndarray) -> np.ndarray:
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks):
            best = ranks.min()
            if best == _NONE:
                break
            at = np.flatnonzero(ranks == best)
            if len(at) > 1:
                same = np.append(True, np.diff(at) > 1)  # of a run of overlapping pairs, every second from the left
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(same, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
                new = np.full(len(at), int(best), np.int64)
                before = ids[np.maximum(at - 1, 0)]
                after = ids[np.minimum(at + 2, len(ids) - 1)]
                met = np.flatnonzero(np.diff(at) == 2)
                made = [self.rank(before, new)[at > 0], self.rank(new, after)[at + 2 < len(ids)], self.rank(new[met], new[met]), self.rank(new[met], after[met])]
                if min((x.min() for x in made if len(x)), default=_NONE) <= best:
                    at = at[:1]
            ids = ids.copy()
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = at - np.arange(len(at))
            ids = ids[keep]
            # Of the old pairs, those that began at a merged pair's second token are gone.
            ranks = ranks[keep[: len(ranks)]] if keep[-1] else np.append(ranks[keep[:-1]], _NONE)[: len(ids) - 1]
            ranks = ranks[: len(ids) - 1]
            touched = np.unique(np.concatenate([place - 1, place]))
            touched = touched[(touched >= 0) & (touched < len(ids) - 1)]
            ranks[touched] = self.rank(ids[touched], ids[touched + 1])
        return ids

    def encode_batch(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(token numbers of all texts, where each text's begin [+1])."""
        split = [self.split(text) if text else [] for text in texts]
        if len(self.known) > CACHE:
            self.forget()
        known = self.known
        new = list(set(chain.from_iterable(split)).difference(known))
        if new:
            made = self.encode_pieces([piece.encode() for piece in new])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, *made]).astype(np.uint32)
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))])
        count = np.fromiter(map(len, split), np.int64, len(split))
        index = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        size = self.start[index + 1] - self.start[index]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[index] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        ends = np.append(0, ends)
        return ids, ends[np.append(0, np.cumsum(count))]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_coders: dict[str, ByteBPE] = {}


def _coder(ranks, pattern: str) -> ByteBPE:
    key = hashlib.sha256(ranks.value + pattern.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBPE(ranks.value, pattern)
    return _coders[key]


def encoded(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>) of every row of docs, with the columns in `keep` that it has.

    rank_file: path of a rank file on the driver (a vocabulary has a fixed size; it is broadcast).
    """
    bounded_batches(docs)
    made = {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    kept = [c for c in keep or [] if c in docs.columns and c not in made]
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in chunks(batches, "text"):
            ids, first = coder.encode_batch(batch.column("text").to_pylist())
            coded = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(first)),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded], pa.string()),
                pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in coded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            columns += [batch.column(f"keep{k}") for k in range(len(kept))]
            names += kept
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(docs.dtypes)
    return docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).alias(f"keep{k}") for k, c in enumerate(kept)]).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + "".join(f", `{c}` {kinds[c]}" for c in kept)
    )
