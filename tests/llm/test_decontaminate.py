import hashlib
import re

from expodex.llm import decontaminate
from expodex.llm.common import table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        own = words(text)
        for k in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[k : k + 10]), set()).add(str(name))
    out = []
    for doc_id, text in docs:
        own = words(text)
        hit, found = [0] * len(own), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if tuple(own[k : k + n]) in windows:
                    found |= windows[tuple(own[k : k + n])]
                    hit[k : k + n] = [1] * n
        out.append((doc_id, len(own), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contamination(d, i).collect()), key=str)
    assert got == brute(docs, items)


def test_short_items_overlaps_and_ties(spark):
    items = [(1, "One two THREE"), (2, "one, two-three"), (3, "a b c d e f g h i j k l"), (4, "x"), (5, None), (6, "..."), (7, "a a a a a a a a a a a"), (10, "é ß 東京")]
    docs = [(1, "zero one two; three four"), (2, "a b c d e f g h i j q"), (3, "a b c d e f g h i j k l m " * 40), (4, "X!"), (5, None), (6, ""), (7, "a " * 500), (8, "É ß 東京 é ß 東京"), (8, "É ß 東京 é ß 東京"), (9, "one two"), (10, "b c d e f g h i j k")]
    check(spark, docs, items)


def test_whole_table(spark, data):
    docs = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, data, "benchmark").select("item_id", "text").collect()]
    check(spark, docs, items)


def test_blocks_of_patterns(spark, data, monkeypatch):
    monkeypatch.setattr(decontaminate, "PATTERNS_PER_BLOCK", 37)
    docs = [tuple(r) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, data, "benchmark").select("item_id", "text").limit(12).collect()]
    check(spark, docs, items)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "row without any"), (None, "the"), (2, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(odd, items).collect()}
    assert got[None].n_hit == 3 and not got[4].contaminated and got[1].n_words == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).filter("contaminated").count() == 0
    kept = decontaminate.decontaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_more_blocks_than_a_task_holds_give_the_same(spark, data, monkeypatch):
    docs, items = table(spark, data, "documents"), table(spark, data, "benchmark")
    want = sorted(map(tuple, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "PATTERNS_PER_BLOCK", 300)
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 1)
    blocks = decontaminate.matchers(items)
    assert len(blocks) > 1
    searched = decontaminate.Searched(blocks)
    assert searched.built is None and len(list(searched)) == len(blocks)
    assert sorted(map(tuple, decontaminate.contamination(docs, items).collect())) == want
