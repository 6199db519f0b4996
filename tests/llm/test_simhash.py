import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from expodex.llm import simhash as S
from expodex.llm.common import table


def fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))] if ws else []
    hashed = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def least(ids, prints):
    """Component of every fingerprint by comparing all pairs."""
    distinct = np.array(sorted(set(prints)), np.uint64)
    label = {int(f): int(f) for f in distinct}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for f in distinct:
        for g in distinct[np.bitwise_count(distinct ^ f) <= 4].tolist():
            label[root(g)] = root(int(f))
    best = defaultdict(list)
    for i, f in zip(ids, prints, strict=True):
        if i is not None:
            best[root(f)].append(i)
    return [min(best[root(f)], default=None) for f in prints]


def held(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    want = sorted(repr((i, f"{f:016x}", c)) for i, f, c in zip(ids, prints, least(ids, prints), strict=True))
    assert sorted(repr(tuple(r)) for r in S.near_duplicates(docs).collect()) == want


def test_whole_table(spark, data):
    held(table(spark, data, "documents"))


def test_odd_rows(spark, odd, none):
    held(odd)
    assert S.near_duplicates(none).count() == 0
    held(spark.createDataFrame([(None, "a b c d e"), (None, "z"), (4, "a\tB\nc  d e"), (3, ""), (2, None)], "doc_id long, text string"))


def test_copies_and_near_copies(spark):
    base = " ".join(f"word{k}" for k in range(400))
    rows = [(k, base) for k in range(50, 200)] + [(k, base.replace(f"word{k * 3} ", "other ")) for k in range(200, 330)] + [(k, f"text {k} of its own " * 3) for k in range(330, 500)]
    held(spark.createDataFrame(rows, "doc_id long, text string"))


def test_buckets_are_split_without_losing_links(spark):
    """Clouds of close fingerprints, chains, and blocks that a third of all share; at every size of a group."""
    rng = np.random.default_rng(8)
    flip = lambda f, n: f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    cloud = [flip(0x0123456789ABCDEF, int(rng.integers(0, 5))) for _ in range(700)]
    shared = [(0x5A5 << 52) | int(rng.integers(0, 1 << 52)) for _ in range(700)]
    other = [int(x) for x in rng.integers(0, 2**64, 700, dtype=np.uint64)]
    chain = [7]
    for _ in range(60):
        chain.append(flip(chain[-1], 4))
    every = sorted(set(cloud + shared + other + chain + [0, 2**64 - 1]))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in every], "f long")
    want = least(every, every)
    for members in (16, 200, 4096):
        label = {f: f for f in every}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        rows = S.links(df, members=members).collect()
        for u, v in rows:
            u, v = u % 2**64, v % 2**64
            assert (u ^ v).bit_count() <= 4
            a, b = sorted((root(u), root(v)))
            label[b] = a
        groups = defaultdict(list)
        for f in every:
            groups[root(f)].append(f)
        assert {f: min(g) for g in groups.values() for f in g} == dict(zip(every, want, strict=True))


@pytest.mark.parametrize("small", [0, 64])
def test_forests_are_forests(small, monkeypatch):
    monkeypatch.setattr(S, "SMALL", small)
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 6, 300))
    own = rng.integers(0, 1 << 9, 300, dtype=np.uint64)
    u, v = S.forests(group, own, 1)
    assert len(u) < 300 and all((a ^ b).bit_count() <= 1 for a, b in zip(u, v, strict=True))


def test_long_texts_in_blocks(monkeypatch):
    texts = ["", "one", "a b c", " ".join(f"w{k % 97}" for k in range(3000)), "Ünï çödé 日本語 x Y", "a b c d"]
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    want = [fingerprint(t) for t in texts]
    for block in (1, 50, 1 << 15):
        monkeypatch.setattr(S, "SHINGLES", block)
        assert S.fingerprints_of(flat, offsets).tolist() == want
