import math
import random

from expodex.llm import topk
from expodex.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, score int, rank string"


def brute(rows, k):
    good = [(i, [math.floor(64.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def got(df, k=20):
    return sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), k).select("query_id", "rank", "vec_id", "score").collect())


def test_whole_table(spark, data):
    vectors = table(spark, data, "embeddings")
    assert got(vectors) == brute([tuple(r) for r in vectors.select("vec_id", "embedding").collect()], 20)


def test_early_stop_blocks_and_ties(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 0.0, 0.1, 3.0 if k % 97 == 0 else 0.2]) * rng.choice([-1, 1]) for _ in range(6)]) for k in range(3000)]
    df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], SCHEMA)
    for block in (16384, 700):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERY_BLOCK", 64)
        assert got(df, 7) == brute(rows, 7)


def test_reading_stops_before_the_lists_end():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = rng.integers(-3, 4, (4000, 8))
    rows[:40] *= 50
    lists = topk.Lists(np.arange(4000), rows, 200.0)
    lists.full = np.full_like(lists.full, 0)  # exact scores over the whole block would come out as 0
    calls = []
    lists._first = lambda name, at, score, k: calls.append(len(at)) or (name, at, score)
    list(lists.best(np.array([10**6]), rows[:1] + 1, 5))
    assert calls and calls[0] < 400


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [0.5, None]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [1e6, -1e6]), (None, [1.0, 1.0]), (3, [1.0]), (4, [1.0, 2.0]), (5, []), (-20, [0.1, 0.1]), (7, [1.0, 2.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], SCHEMA)
    assert got(df) == brute(rows, 20)
    assert got(df.limit(0)) == []
    assert got(df.filter("vec_id = 0")) == []


def test_hard_queries_are_answered_without_the_whole_product():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = np.floor(64 * rng.normal(0, 1, (4000, 16))).astype(np.int64)  # half and three quarters of the lists decide nothing here
    lists = topk.Lists(np.arange(4000), rows, 1000.0)
    sizes, first = [], lists._first
    lists._first = lambda name, at, score, k: sizes.append(len(at)) or first(name, at, score, k)
    queries = np.floor(64 * rng.normal(0, 1, (20, 16))).astype(np.int64)
    got = {int(name): (ids.tolist(), score.tolist()) for name, ids, score in lists.best(np.arange(10**6, 10**6 + 20), queries, 20)}
    assert len(lists.read) > 2  # read on beyond 0.75
    assert len(sizes) == 20 and max(sizes) < 2000
    for k, q in enumerate(queries):
        exact = rows @ q
        order = np.lexsort((np.arange(4000), -exact))[:20]
        assert got[10**6 + k] == (order.tolist(), exact[order].tolist())
