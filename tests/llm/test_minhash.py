import random
import re

import numpy as np

from expodex.llm import minhash
from expodex.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, width):
    out = {}
    for doc_id, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        n = min(width, len(words))
        out[doc_id] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    return out


def brute(rows, width):
    own = sets_of(rows, width)
    ids = sorted(own)
    to = {i: i for i in ids}

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and own[a] and own[b]:
                same = len(own[a] & own[b])
                if 100 * same >= 80 * (len(own[a]) + len(own[b]) - same):
                    x, y = find(a), find(b)
                    to[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i)) for i in ids}


def mutated(rng, words, share):
    return [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(9999)) if rng.random() < share else w for w in words]


def check(spark, rows, width):
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_against_brute_force_with_chains_and_groups(spark):
    rng = random.Random(4)
    rows, k = [], 0
    for _ in range(6):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(12):
            rows.append((k, " ".join(mutated(rng, base, rng.choice([0, 0.01, 0.03, 0.05])))))
            k += 1
        step = base
        for _ in range(6):  # a chain whose ends are unlike
            step = mutated(rng, step, 0.04)
            rows.append((k, " ".join(step)))
            k += 1
    rng.shuffle(rows)
    check(spark, rows, 2)


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    check(spark, rows, 5)


def test_odd_rows(spark, odd, none):
    rows = minhash.near_duplicates(odd, 2).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[1].kept and by[2].kept and by[3].kept
    assert by[4].component_id == by[5].component_id == 4 and by[4].kept and not by[5].kept
    assert by[None].component_id is None and by[None].kept
    assert by[7].n_shingles > 10000 and by[9].n_shingles == 1
    assert minhash.near_duplicates(none).count() == 0


def test_one_of_each_keeps_columns_and_repeats_nothing(spark, odd, none):
    kept = minhash.one_of_each(odd, 2)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id) == [1, 2, 3, 4, 7, 8, 9, 10]
    assert minhash.one_of_each(none).count() == 0


def test_min_and_max_are_unbiased():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    agree = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(agree - 0.5) < 0.12
    half = len(minhash.signature(a)) // 2
    assert half == minhash.PERMUTATIONS


def test_components_of_chains_and_stars(spark):
    from expodex.llm.graph import components

    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(139, 200), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {200: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_scratch_tables_that_nothing_reads_are_removed(tmp_path, odd, monkeypatch):
    import os

    from expodex.llm import common

    monkeypatch.setattr(common, "scratch_dir", lambda spark: f"file://{tmp_path}")
    rows = minhash.near_duplicates(odd, 2)
    left = {n.partition("-")[0] for n in os.listdir(tmp_path)}
    assert rows.count() == odd.count() and left <= {"named", "edges", "groups"}


def test_different_texts_of_a_repeated_id_stay(spark):
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    near_b = b + " end"
    c = " ".join(f"c{k}" for k in range(60))
    rows = [(7, a, 1), (7, b, 2), (9, near_b, 3), (9, c, 4), (9, c, 5), (3, near_b + " here", 6), (8, "", 7), (8, " ", 8), (None, b, 9), (11, None, 10)]
    for parts in (1, 5):
        kept = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(parts))
        got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
        assert kept.columns == ["doc_id", "text", "extra"]
        assert got == sorted([("7", a), ("3", near_b + " here"), ("9", c), ("8", ""), ("None", b), ("11", "")])
