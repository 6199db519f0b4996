import hashlib
import random
import re

import numpy as np

from expodex.llm import pii
from expodex.llm.common import table

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    return sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(digits[::-1])) % 10 == 0


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return [True, all(int(p) <= 255 for p in text.split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15][kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if fits(k, m.group())]


def test_base_spans_against_the_patterns():
    rng = random.Random(3)
    for alphabet in ("0123456789  ..--()+@a.b%é\n", "0012345 -.+(", "ab.@-1"):
        for _ in range(15000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
            assert pii.base_spans(text) == brute(text), text


def test_linear_on_long_runs():
    for text in ("1" * 200000, "a" * 200000 + "@", "1 " * 100000, "1." * 100000, "@a" * 50000, "1-" * 100000, "[at]" * 30000):
        pii.more_candidates(text, pii.base_spans(text))


def test_whole_table_and_odd_rows(spark, data, odd, none):
    for docs in (table(spark, data, "documents"), odd):
        rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
        got = sorted(pii.found(docs).collect(), key=lambda r: (str(r.doc_id)))
        assert len(got) == len(rows)
        want = sorted((str(i), *[sum(s[0] == k for s in brute(t)) for k in range(4)], hashlib.sha256(pii.written(brute(t)).encode()).hexdigest()) for i, t in rows)
        assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
        spans = {r.doc_id: set(r.spans.split(",")) for r in got}
        assert all({f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in brute(t)} <= spans[i] for i, t in rows)
    assert pii.found(none).count() == 0


def test_added_spans_come_from_the_labelers(spark):
    rows = [(k, f"call +1 (555) 555-{k:04} or mail u{k}@x.com") for k in range(200)]
    rows += [(200 + k, f"phone: (212) 555-{k:04}, joe [at] mail [dot] com") for k in range(20)]
    rows += [(300 + k, f"order 212-555-{k:04}") for k in range(60)]
    got = {r.doc_id: r.spans for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("phone:7:21" in got[200 + k] and "email:23:46" in got[200 + k] for k in range(20))
    assert all(got[300 + k] == "" for k in range(60))  # the context labeler's no


def test_reliabilities_follow_the_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    votes = [np.where(rng.random(4000) < right, np.where(truth, 2, 1), np.where(truth, 1, 2)) for right in (0.95, 0.9, 0.85, 0.55)]
    pattern = np.zeros(4000, np.int64)
    for v in votes:
        pattern = pattern * 3 + v
    judge = pii.Judge(pattern, np.zeros(4000, np.int64), np.ones(4000, np.int64))
    assert abs(judge.reliability[0, 1, 2] - 0.95) < 0.04 and abs(judge.reliability[3, 1, 2] - 0.55) < 0.06


def test_masking_keeps_columns_and_rows(spark, odd):
    df = odd.unionByName(spark.createDataFrame([(50, "mail a@b.co, +1 (555) 555-1234!", "en", "s", 32, None, None)], odd.schema))
    got = pii.redacted(df)
    assert got.columns == df.columns and got.count() == df.count()
    row = got.filter("doc_id = 50").first()
    assert row.text == "mail <EMAIL>, <PHONE>!" and row.n_chars == len(row.text)


def test_estimates_equal_a_plain_expectation_maximisation():
    """The same rounds over single spans, one by one, without counts or arrays."""
    rng = random.Random(7)
    spans = [(rng.randrange(4), tuple(rng.choice((0, 1, 2, 2)) for _ in range(4))) for _ in range(300)]
    p = [(sum(v == 2 for v in vs) + 0.5) / (sum(v > 0 for v in vs) + 1.0) for _, vs in spans]
    for _ in range(40):
        prior = [(sum(q for (k, _), q in zip(spans, p) if k == kind) + 1) / (sum(k == kind for k, _ in spans) + 2) for kind in range(4)]
        rel = [[[0.0] * 3 for _ in range(2)] for _ in range(4)]
        for j in range(4):
            for y in range(2):
                seen = [1.0, 1.0, 1.0]
                for (_, vs), q in zip(spans, p):
                    seen[vs[j]] += q if y else 1 - q
                rel[j][y] = [0.0, *(x / sum(seen[1:]) for x in seen[1:])]
        now = []
        for kind, vs in spans:
            odds = [1 - prior[kind], prior[kind]]
            for j in range(4):
                for y in range(2):
                    odds[y] *= rel[j][y][vs[j]] if vs[j] else 1.0
            now.append(odds[1] / sum(odds))
        p = now

    def number(kind, vs):
        for v in vs:
            kind = kind * 3 + v
        return kind

    keys = sorted({number(*x) for x in spans})
    count = np.array([sum(number(*x) == k for x in spans) for k in keys])
    judge = pii.Judge(np.array(keys), np.zeros(len(keys), np.int64), count)
    assert np.allclose(judge.reliability, rel, atol=1e-9)
    got = dict(zip(keys, judge.probability, strict=True))
    assert all(abs(got[number(*x)] - q) < 1e-9 for x, q in zip(spans, p))


def planted(rng, k):
    """(text, planted spans beyond the base patterns): one kind of personal data or one decoy."""
    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        while not luhn(d := rng.choice(["4", "51", "37"]) + digits(14)):
            d = d[:16]
        return d[:16] if luhn(d[:16]) else card()

    c = card()
    yes = [
        ("write to ", f"u{k} [at] mail [dot] com"), ("email me: ", f"ann.{k} at proton dot org"), ("login from ", f"{rng.randrange(1, 223)}[.]{rng.randrange(256)}[.]{rng.randrange(256)}[.]{rng.randrange(256)}"),
        ("card: ", ".".join(c[i : i + 4] for i in (0, 4, 8, 12))), ("call ", f"0049 30 {digits(3)} {digits(4)}"), ("phone: ", f"(212) 555-{digits(4)}"), ("Tel. ", f"030/{rng.randrange(1, 10)}{digits(6)}"), ("mobile ", f"0{rng.randrange(1, 10)}{digits(9)}"),
    ]
    no = [("order ", f"212-555-{digits(4)}"), ("version ", f"{digits(3)}.{digits(4)}.{digits(3)}"), ("look at the dot on page ", digits(3)), ("serial ", "9999.1111.2222.3334"), ("sum ", f"{digits(3)} {digits(3)}")]
    lead, own = rng.choice(yes if k % 2 else no)
    text = f"some words {lead}{own}, then more words"
    at = text.index(own, len("some words " + lead))
    return text, [(at, at + len(own))] if k % 2 else []


def test_added_spans_on_planted_data(spark):
    rng = random.Random(11)
    rows = [(k, *planted(rng, k)) for k in range(2000)]
    filler = [(5000 + k, f"call +1 (555) 555-{k:04} or mail u{k}@x.com from 10.0.{k % 250}.7") for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + filler, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.found(docs).collect()}
    right = wrong = missed = 0
    for k, text, want in rows:
        base = {f"{pii.KINDS[x]}:{a}:{b}" for x, a, b in brute(text)}
        added = {tuple(map(int, s.split(":")[1:])) for s in got[k].split(",") if s and s not in base}
        right += len(added & set(want))
        wrong += len(added - set(want))
        missed += len(set(want) - added)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.85, (right, wrong, missed)
