import re

import pytest

import corpus_pipeline as P
from expodex.llm.common import table


def shingle_sets(rows):
    out = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        n = min(5, len(words))
        out[doc_id] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    return out


def test_every_stage_against_brute_force(spark, data):
    docs = table(spark, data, "documents")
    after = {}
    rows = docs
    for name, stage in P.STAGES:
        before, rows = rows, stage(spark, rows, data).cache()
        after[name] = (before, rows)
    names = [n for n, _ in P.STAGES]
    for n in names[:-1]:
        assert after[n][1].columns == docs.columns
    before, kept = after[names[0]]
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()}
    assert all(not any(c.isalpha() for c in r.text) for r in before.collect() if r.doc_id in gone)
    before, kept = after[names[1]]
    sets = shingle_sets([(r.doc_id, r.text) for r in before.collect()])
    left = {r.doc_id for r in kept.collect()}
    ids, to = sorted(sets), {i: i for i in sets}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                    x, y = a, b
                    while to[x] != x:
                        x = to[x]
                    while to[y] != y:
                        y = to[y]
                    to[max(x, y)] = min(x, y)
    assert left == {i for i in ids if to[i] == i}
    before, kept = after[names[2]]
    from test_decontaminate import brute

    dirty = {r[0] for r in brute([(r.doc_id, r.text) for r in before.collect()], [tuple(r) for r in table(spark, data, "benchmark").select("item_id", "text").collect()]) if r[5]}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()} == dirty
    from expodex.llm.pii import base_spans

    before, kept = after[names[3]]
    assert before.count() == kept.count() and not any(base_spans(r.text) for r in kept.collect())
    before, kept = after[names[4]]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in kept.collect()}
    whole = {tuple(r)[:4] for r in P.run(spark, data).collect()}
    assert whole == {tuple(r)[:4] for r in kept.collect()}


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_stages_take_odd_and_empty_tables(spark, data, odd, none, k):
    assert P.STAGES[k][1](spark, none, data).count() == 0
    assert P.STAGES[k][1](spark, odd, data).count() > 0
