import zlib
from collections import Counter, defaultdict

import numpy as np

from expodex.llm import shard
from expodex.llm.common import table


def check(docs, got, bins=40):
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < bins and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    load = np.zeros((bins, 2))
    for r in got:
        load[r.shard] += (r.size, 1)
    return load


def test_whole_table_and_odd_rows(spark, data, odd, none):
    docs = table(spark, data, "documents")
    check(docs, shard.shards(docs).collect())
    check(odd, shard.shards(odd).collect())
    assert shard.shards(none).count() == 0


def test_balance_with_a_hot_group(spark):
    rows = [(k, "copy of one text" if k % 3 == 0 else f"text {k} " * (k % 17 + 1)) for k in range(12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard.shards(docs).collect()
    load = check(docs, got)
    assert (load.max(axis=0) / load.min(axis=0) < 1.05).all()


def test_equal_texts_stay_together(spark):
    rows = [(k, f"text {k // 3} " * (k // 3 % 40)) for k in range(6000)]
    got = shard.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    where = defaultdict(set)
    for r in got:
        where[rows[r.doc_id][1]].add(r.shard)
    assert all(len(v) == 1 for t, v in where.items() if t)


def test_pack_equals_a_plain_packing():
    rng = np.random.default_rng(2)
    for _ in range(30):
        vectors = rng.random((int(rng.integers(1, 60)), 3)) / 20
        capacity = rng.random((int(rng.integers(1, 9)), 3))
        want, left = [], [list(map(float, c)) for c in capacity]
        for v in vectors.tolist():
            dots = [sum(a * b for a, b in zip(c, v)) for c in left]
            fitting = [k for k, c in enumerate(left) if all(a >= b for a, b in zip(c, v))] or range(len(left))
            best = max(fitting, key=lambda k: (round(dots[k], 12), -k))
            want.append(best)
            left[best] = [a - b for a, b in zip(left[best], v)]
        assert shard.pack(vectors, capacity.copy()).tolist() == want


def test_whole_tables_are_balanced(spark, monkeypatch):
    """Several ranges, long texts among short ones: every shard within two per cent of the mean."""
    monkeypatch.setattr(shard, "PER_RANGE", 2000)
    rows = [(k, f"t{k} " * (1 + k * 7919 % 200 if k % 50 else 1500)) for k in range(12000)]
    load = check(df := spark.createDataFrame(rows, "doc_id long, text string"), shard.shards(df).collect())
    assert (load.max(axis=0) / load.mean(axis=0) < 1.02).all()
