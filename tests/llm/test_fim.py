import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from expodex.llm import fim
from expodex.llm.common import table

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "char": r"[\s\S]"}


def plain(doc_id, text, unit="line"):
    """The transformation of one text, unit by unit."""
    text = text or ""
    units = re.findall(UNITS[unit], text)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or any(s in text for s in fim.SENTINELS) else "spm" if h4 % 100 < 50 else "psm"
    out = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    return doc_id, len(units), form, out


def held(docs, unit="line"):
    want = sorted(map(repr, (plain(r.doc_id, r.text, unit) for r in docs.select("doc_id", "text").collect())))
    made = fim.transformed(docs, unit=unit)
    made = made.select("doc_id", "n", "form", "output", fim.restored(made.output, made.form).alias("back"), "prefix", "middle", "suffix")
    rows = made.collect()
    assert sorted(repr(tuple(r[:4])) for r in rows) == want
    assert all(r.back == r.prefix + r.middle + r.suffix for r in rows)


def test_whole_table_and_odd_rows(spark, data, odd, none):
    held(table(spark, data, "documents"))
    held(odd)
    for unit in ("word", "char"):
        held(odd.filter("doc_id <> 7"), unit)
    assert fim.digests(none).count() == 0


def test_sentinels_blank_lines_and_long_texts(spark):
    texts = ["a<P>b\nc", "<S>", "x <M", "\n", "\n\n\n", "a\r\nb", "one line", "é\n日本\n🙂", "  no end\x0b of line", None, "", "line\n" * 40000, "x" * 100000 + "\n" + "y" * 9000, "<P\n>\n<"]
    held(spark.createDataFrame([(k * 7 + j, t) for k, t in enumerate(texts) for j in range(5)], "doc_id long, text string"))


def test_digests_of_copies(spark):
    got = fim.digests(spark.createDataFrame([(1, "a\nb\n")] * 3 + [(2, "a\nb\n")], "doc_id long, text string")).collect()
    assert len({tuple(r) for r in got if r.doc_id == 1}) == 1
    assert {r.restored_sha256 for r in got} == {hashlib.sha256(b"a\nb\n").hexdigest()}


def test_rates(spark):
    docs = spark.createDataFrame([(k, "a\nb\n") for k in range(2000)], "doc_id long, text string")
    forms = dict(fim.transformed(docs, rate=60, spm=25).groupBy("form").count().collect())
    assert abs(forms["plain"] / 2000 - 0.4) < 0.05 and abs(forms["spm"] / 2000 - 0.15) < 0.05


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\n é🙂<P>", max_size=40), min_size=1, max_size=6), st.integers(1, 9), st.sampled_from(sorted(UNITS)), st.data())
def test_cuts_equal_a_plain_scan(texts, chunk, unit, data):
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    draws = np.array([data.draw(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))) for _ in texts], np.int64)
    n, places = fim.cuts(flat, offsets, draws, fim.UNITS[unit], chunk)
    for k, t in enumerate(texts):
        units = re.findall(UNITS[unit], t)
        assert n[k] == len(units)
        assert (places[k] - offsets[k]).tolist() == sorted(len("".join(units[: int(d) % (len(units) + 1)]).encode()) for d in draws[k])


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_no_texts(unit):
    n, places = fim.cuts(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros((0, 2), np.int64), fim.UNITS[unit])
    assert len(n) == 0 and places.shape == (0, 2)
