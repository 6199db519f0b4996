import math
import re
import zlib
from collections import Counter

import pytest

from expodex.llm import suffixtree
from expodex.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def held(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7 == 2


def check(rows, got):
    counts = Counter()
    for doc_id, text in rows:
        if held(doc_id) is False:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), held(i), len(t := tokens(x)), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 5)) for i, x in rows
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


@pytest.mark.parametrize("heavy", [1 << 20, 300])
def test_base_is_exact_and_the_tree_is_better(spark, data, monkeypatch, heavy):
    monkeypatch.setattr(suffixtree, "HEAVY", heavy)  # the smaller one leaves most tokens to the join
    docs = table(spark, data, "documents")
    got = suffixtree.scores(docs).collect()
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], got)
    mine, base = (sum(r[k] for r in got if r.held_out) for k in ("score", "base_score"))
    assert mine > base


def test_repeated_rows_and_nulls(spark, odd, none, monkeypatch):
    monkeypatch.setattr(suffixtree, "HEAVY", 2)
    monkeypatch.setattr(suffixtree, "_COPIES", 2)  # copies are given out in several steps
    check([tuple(r) for r in odd.select("doc_id", "text").collect()], suffixtree.scores(odd).collect())
    assert suffixtree.scores(none).count() == 0


def test_turns_share_the_parts_and_change_no_result(spark, data, monkeypatch):
    monkeypatch.setattr(suffixtree, "HEAVY", 300)
    docs = table(spark, data, "documents")
    docs = docs.union(docs.limit(20))
    seen = []
    monkeypatch.setattr(suffixtree, "_found", lambda *a, f=suffixtree._found: seen.append(a[2:]) or f(*a))
    of = lambda: sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffixtree.scores(docs).collect())
    monkeypatch.setattr(suffixtree, "_SLICES", 1)
    whole = of()
    monkeypatch.setattr(suffixtree, "_SLICES", 3)
    monkeypatch.setattr(suffixtree, "_FLUSH", 3000)  # rows lie in several packets
    assert of() == whole
    assert seen == [(0, 1), (0, 3), (1, 3), (2, 3)]


def test_no_training_rows(spark, odd):
    only = odd.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2 or doc_id is null")
    check([tuple(r) for r in only.select("doc_id", "text").collect()], suffixtree.scores(only).collect())


def test_distributions_sum_to_one(spark):
    import numpy as np

    words = [f"a{k % 5} b{k % 3} c{k % 7}" for k in range(600)]
    rows = [(k, " ".join(words[k : k + 9])) for k in range(590)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = suffixtree.trained(docs)
    everything = np.arange(len(model.counts))
    unknown = 1 / (model.total + model.kinds + 1)
    assert model.levels and model.levels[0]["kept"].any()
    for depth in range(len(model.levels) + 1):
        for context in range(len(model.levels[depth - 1]["kept"]) if depth else 1):
            p = model.chance(np.full(len(everything), context), everything, depth)
            assert p.sum() <= 1 + 1e-9 and p.sum() > 1 - 2 * unknown - 1e-6


def test_rare_contexts_are_states_at_every_size(spark, monkeypatch):
    """A phrase that occurs four times is learned however much other text there is, and scores equal a plain recursion."""
    filler = [f"w{(k * 7919) % 4001} v{(k * 104729) % 3989}" for k in range(160_000)]
    texts = [" ".join(filler[k : k + 200]) for k in range(0, len(filler), 200)] + ["quite rare phrase indeed here"] * 4
    train = [i for i in range(2000) if held(i) is False][: len(texts)]
    test = next(i for i in range(2000) if held(i))
    rows = [*zip(train, texts, strict=True), (test, "quite rare phrase indeed here")]
    counts = [Counter() for _ in range(5)]

    def path(text):
        t = [None, *tokens(text)]
        return [(t[max(0, i - 3) : i], t[i]) for i in range(1, len(t))]

    for _, text in rows[:-1]:
        for before, x in path(text):
            counts[0][x] += 1
            for d in range(1, len(before) + 1):
                counts[d][(*before[-d:], x)] += 1
    n, v = sum(counts[0].values()), len(counts[0])
    follow, states = {}, {}
    for d in (1, 2, 3):
        for gram, c in counts[d].items():
            if c >= 2:
                follow.setdefault(gram[:-1], {})[gram[-1]] = c

    def total(context):
        return counts[0][context[0]] if len(context) == 1 else counts[len(context) - 1][context]

    def state(context):
        if context not in states:
            cells = follow.get(context, {})
            states[context] = None
            if total(context) >= 4 and cells:
                share = {x: (c - 0.5) / total(context) for x, c in cells.items()}
                left = 1 - sum(share.values())
                below = {x: chance(context[1:], x) for x in cells}
                full = {x: share[x] + left * below[x] for x in cells}
                rest, base = 1 - sum(full.values()), 1 - sum(below.values())
                gain = sum(p * math.log(p / below[x]) for x, p in full.items()) + (rest * math.log(rest / base) if rest > 1e-12 and base > 1e-12 else 0)
                if gain >= 0.05:
                    states[context] = share, left
        return states[context]

    def chance(context, x):
        if not context:
            return (counts[0][x] + 1) / (n + v + 1)
        lower = chance(context[1:], x)
        kept = state(context)
        return lower if kept is None else kept[0].get(x, 0.0) + kept[1] * lower

    want = {i: sum(math.log10(chance(tuple(b), x)) for b, x in path(text)) for i, text in rows}
    assert 4 < n * 2.0**-16  # four occurrences lie below a share of 2^-16
    for heavy in (1 << 20, 10):  # all broadcast, nearly all joined
        monkeypatch.setattr(suffixtree, "HEAVY", heavy)
        got = {r.doc_id: r for r in suffixtree.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i].score - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want)
    assert got[test].score > got[test].base_score + 10


def test_the_filter_of_slots_never_denies_what_occurs_twice(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    places = np.unique(rng.integers(0, 1 << 19, 5000))
    places = np.unique(np.concatenate([places, [0, 65534, 65535, 65536, 131071, (1 << 19) - 1]]))
    assert suffixtree._places(suffixtree._gaps(places)).tolist() == places.tolist()
    assert suffixtree._places(suffixtree._gaps(places[:0])).tolist() == []
    rows = [(f"a{k % 50} b{k} c{k % 9}",) for k in range(500)]
    texts = spark.createDataFrame(rows, "text string").repartition(3)

    class Every:
        value = (lambda h: np.ones(len(h), bool), lambda h: np.ones(len(h), bool))

    token = np.concatenate([suffixtree.tokens(b)[0] for b in texts.toArrow().to_batches()])
    _, (_, own, _, _) = suffixtree.grams(token, 2)
    keys, n = np.unique(own, return_counts=True)
    held = suffixtree.twice_of(texts, 2, Every, len(token))(keys)
    assert held[n > 1].all() and not held[n == 1].all()


def test_large_contexts_rare_tokens_and_steps_change_no_result(spark, data, monkeypatch):
    docs = table(spark, data, "documents")
    docs = docs.union(docs.limit(20)).union(docs.limit(5).selectExpr("cast(null as bigint)", "text", "lang", "source", "n_chars"))
    of = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffixtree.scores(docs).collect())
    whole = of()
    large = []
    monkeypatch.setattr(suffixtree, "_large", lambda *a, f=suffixtree._large: large.append(f(*a)) or large[-1])
    monkeypatch.setattr(suffixtree, "_LARGE", 8)  # contexts of every length are large
    monkeypatch.setattr(suffixtree, "_PARTS", 4096)
    monkeypatch.setattr(suffixtree, "HEAVY", 300)
    monkeypatch.setattr(suffixtree, "_STEP", 20)
    assert of() == whole
    assert all(large[0][0])


def test_an_occurrence_travels_once_and_a_part_gives_back_a_row_a_packet(spark, data, monkeypatch):
    packets, back = [], []

    def counted(kind, f):
        def of(*a):
            df = f(*a)
            kind.append(df)
            return df

        return of

    monkeypatch.setattr(suffixtree, "stored", counted(back, suffixtree.stored))
    monkeypatch.setattr(suffixtree, "_found", counted(packets, suffixtree._found))
    monkeypatch.setattr(suffixtree, "_PARTS", 16)
    docs = table(spark, data, "documents")
    got = suffixtree.scores(docs).collect()
    assert len(packets) == suffixtree._SLICES == 1
    sums = back[-1].select("flush", "m").collect()  # rows of the tables: packets, not rows of documents
    assert len(sums) <= 16 * len({r.flush for r in sums}) < len(got) * 16
    assert sum(r.m for r in sums) <= sum(r.n_tokens for r in got)


def test_rows_in_another_order_are_refused():
    import numpy as np
    import pyarrow as pa

    docs = np.zeros(2, suffixtree._DOC)
    docs["row"], docs["n_tokens"], docs["sent"] = [0, 1], 3, [2, 3]

    def rows(n):
        runs = suffixtree._packed(np.array([[0, 1], n, [1, 1]], np.uint32))
        zero = np.zeros(2).tobytes()
        return suffixtree._rows((0,), pa.table({"flush": [0], "m": [2], "runs": [runs], "gains": [zero], "bases": [b""], "docs": [docs.tobytes()]}))

    assert rows([2, 3]).num_rows == 2
    with pytest.raises(RuntimeError):
        rows([3, 2])
