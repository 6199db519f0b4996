import hashlib

import numpy as np
import pytest

from expodex.llm import centroids as C
from expodex.llm.common import table


def plain(rows, k=40, rounds=5, dims=64, scale=256):
    """Lloyd over every row in Python integers."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dims and all(c is not None and np.isfinite(c) for c in x):
            kept.append((vec_id, [int(np.floor(float(c) * scale)) if abs(c) * scale < C.LIMIT else int(np.sign(c)) * C.LIMIT for c in x]))
    name = lambda i: hashlib.sha256(f"2:{'null' if i is None else i}".encode()).hexdigest()
    means = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(means))

    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for j in range(len(means)):
            own = [v for (_, v), t in zip(kept, to) if t == j]
            if own:
                means[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in last)
    sums = {j: sum(d for _, t, d in last if t == j) for j in range(len(means))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted((repr((i, t, d, sums[t], total, sha[t])) for i, t, d in last))


def held(df, **how):
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    assert sorted(repr(tuple(r)) for r in C.clustered(df, **how).collect()) == plain(rows, **how)


SCHEMA = "vec_id long, embedding array<double>, cluster string, w string, v int"


def test_whole_table(spark, data):
    held(table(spark, data, "embeddings"), k=7, rounds=2)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (None, [1.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [-inf, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [-1.0, -0.001]), (11, [1e30, -1e30]), (12, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    held(df, k=3, rounds=4, dims=2)
    held(df, k=40, rounds=1, dims=2)
    assert C.clustered(df.limit(0), dims=2).count() == 0
    assert C.clustered(df, dims=5).count() == 0


def test_a_hot_vector_and_empty_clusters(spark):
    rng = np.random.default_rng(3)
    some = rng.normal(size=(300, 4)).round(2).tolist()
    rows = [(k, [0.125, -3.0, 2.0, 0.0] if k % 3 else some[k % 300], "x", "y", 1) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    held(df, k=9, rounds=3, dims=4)
    back = C.clustered(df, k=9, rounds=3, dims=4)
    assert back.groupBy("vec_id").count().filter("count <> 1").isEmpty() and back.count() == 3000


@pytest.mark.parametrize("most", [100, 1 << 20, C.LIMIT])
def test_distances_are_exact(most):
    rng = np.random.default_rng(4)
    v, c = rng.integers(-most, most + 1, (50, 64)), rng.integers(-most, most + 1, (6, 64))
    c[3] = c[1]
    v[0], c[0] = most, -most
    to, apart = C.nearest(v, c)
    for a, t, d in zip(v.tolist(), to, apart, strict=True):
        assert (d, t) == min((sum((x - y) ** 2 for x, y in zip(a, b)), j) for j, b in enumerate(c.tolist()))
