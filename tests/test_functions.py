import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from expodex import dictionaries as D
from expodex.functions import scoring as S
from expodex.functions import text as X
from expodex.functions import urls as U


def column(spark, values, *exprs, names=("x",)):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    return [tuple(r) for r in spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(*exprs).collect()]


def test_resolving_agrees_with_the_standard_library(spark):
    rng = random.Random(2)
    bases = ["https://ex.org/a/b/c.html?q=1", "http://Ex.ORG/", "https://ex.org/a/b/", "https://ex.org"]
    hrefs = ["/x/y", "z", "../up", "../../../far/", "./here", "?page=2", "//other.com/p", "https://abs.net/q#f", "a/./b/../c", "..", ".", "/x/../y/./z"]
    hrefs += ["/".join(rng.choice(["a", "b", "..", "."]) for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    pairs = [(h, b) for h in hrefs for b in bases]
    got = column(spark, pairs, U.resolved(F.col("h"), F.col("b")), names=("h", "b"))
    for (h, b), (g,) in zip(pairs, got, strict=True):
        want = urljoin(b, h)
        assert g.split("#")[0].rstrip("/") == want.split("#")[0].rstrip("/"), (h, b)


def test_normalising_is_idempotent_and_closed(spark):
    values = [("MAILTO:a@b", "https://ex.org"), ("javascript:x()", "https://ex.org"), ("", "https://ex.org"), (None, "https://ex.org"), ("/A/b//?x=1#f", "https://EX.org/q"), ("https://A.b/", "x"), ("ftp://a/b", "https://ex.org")]
    once = column(spark, values, U.normalized(F.col("h"), F.col("b")), names=("h", "b"))
    assert [x[0] for x in once] == ["", "", "", "", "https://ex.org/A/b?x=1", "https://a.b/", ""]
    twice = column(spark, [(x[0], "https://ex.org") for x in once], U.normalized(F.col("h"), F.col("b")), names=("h", "b"))
    assert once == twice


def test_ignored_paths_are_tested_on_the_path(spark):
    values = ["https://e.org/cdn-cgi/x", "https://e.org/a.PDF", "https://login.org/x", "https://e.org/login?x"]
    assert [r[0] for r in column(spark, values, U.is_ignored(F.col("x")))] == [True, True, False, True]


def test_registered_domains(spark):
    values = ["a.b.co.uk", "co.uk", "example.com", "x.y.example.com:8080", "localhost", ""]
    assert [r[0] for r in column(spark, values, U.registered_domain(F.col("x")))] == ["b.co.uk", "co.uk", "example.com", "example.com", "localhost", ""]


def test_link_scores_of_the_documented_cases(spark):
    values = [("https://ex.org/exhibitors", "Exhibitor list"), ("https://www.cnn.com/a", "exhibitors")]
    assert column(spark, values, S.link_score(F.col("u"), F.col("t"), F.lit("")), S.link_reasons(F.col("u"), F.col("t"), F.lit("")), names=("u", "t")) == [
        (11, ["url_strong:exhibitor", "url_strong:exhibitors"]),
        (-10, ["news_media_blocked"]),
    ]


def test_confidence_of_the_documented_cases(spark):
    def record(**fields):
        return tuple(fields.get(f, "") for f in D.CORE_FIELDS)

    every = dict.fromkeys(D.CORE_FIELDS, "x")
    values = [
        record(name="a"), record(name="a", website="w", email="e"), record(name="a", website="w", email="e", description="d" * 30),
        record(name="a", address="x", city="x", country="x", category="x"), record(**(every | {"description": "please book a demo " + "d" * 50})), record(website="w"), record(name=" "),
    ]
    got = column(spark, values, X.confidence({f: F.col(f) for f in D.CORE_FIELDS}), names=D.CORE_FIELDS)
    assert [r[0] for r in got] == [0.111, 0.333, 0.344, 0.35, 0.8, 0.0, 0.0]


def test_names_and_text(spark):
    names = ["Home", "2026", "AI/ML", "A/B/C", "Drone Zone", "2J Antennas", "Energy/Power", "Contact Lens Co", None]
    assert [r[0] for r in column(spark, names, X.valid_name(F.col("x")))] == [None, None, None, None, None, "2J Antennas", "Energy/Power", "Contact Lens Co", None]
    assert [r[0] for r in column(spark, ["Acme Inc", "Acme Ltd.", "ACME", "中文公司", None], X.company_key(F.col("x")))] == ["acme", "acme", "acme", "", None]
    assert [r[0] for r in column(spark, ["two clean words", "~$+*@^|= []~~", "ab", "中文文字内容内容内容", None], X.looks_like_text(F.col("x")))] == [True, False, False, True, False]
    assert [r[0] for r in column(spark, ["a\x01b", "x" * 4 + "☃" * 9, "Łódź żółć źdźbło", None], X.sanitized(F.col("x")))] == ["ab", "", "Łódź żółć źdźbło", ""]


def test_social_handles_and_booths(spark):
    values = ["https://twitter.com/intent/tweet https://x.com/acme", "see https://www.linkedin.com/company/acme-inc/ now", "Hall: 2 | Stand: 2C-05", "no"]
    got = column(spark, values, X.twitter(F.col("x")), X.linkedin(F.col("x")), X.booth(F.col("x")))
    assert got[0][0] == "https://twitter.com/acme" and got[1][1] == "https://www.linkedin.com/company/acme-inc" and got[2][2] == "Hall: 2 | Stand: 2C-05" and got[3] == (None, None, None)


def test_language_falls_back_to_script(spark):
    values = [("en-GB", "x"), ("", "中文字符内容在这里"), (None, "Русский текст"), ("", "plain")]
    assert [r[0] for r in column(spark, values, X.language(F.col("l"), F.col("t")), names=("l", "t"))] == ["en", "zh", "ru", "unknown"]
