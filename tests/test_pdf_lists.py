"""Lists of documents: each row of the table is a document of its own, and headers and entries run on within it."""

from pyspark.sql import functions as F

from expodex.functions import text as X
from expodex.operators import pdf

TABLE = "| COMPANY | COUNTRY |\n|---|---|\n| Acme | JAPAN |\n| acme | Turkey |\nno row\n| STAND | EXHIBITOR |\n| B1 | Beta |\n| | |\n| B2 | B |"


def test_table_headers_carry_forward_within_a_document(spark):
    docs = spark.createDataFrame([("u", "| Early | row |\n" + TABLE), ("u", TABLE), (None, None)], "url string, markdown string")
    got = sorted((r.line, r.name, r.country, r.booth_number) for r in pdf.table_rows(docs).collect())
    own = [(2, "Acme", "Japan", None), (6, "Beta", None, "B1")]
    assert got == sorted(own + [(k + 1, *rest) for k, *rest in own])


def test_numbered_entries_run_on_within_a_document(spark):
    one = "Title\n\n1 Acme  Japan\n\nA1\n\n2 Beta\n\nPage 4\n\n3 Gamma  (x)  Turkey"
    docs = spark.createDataFrame([("u", one), ("u", "Lost\n\n7 Delta  oman"), (None, None)], "url string, markdown string")
    got = sorted((r.line, r.name, r.country, r.booth_number) for r in pdf.numbered_rows(docs).collect())
    assert got == [(1, "Acme", "Japan", "A1"), (1, "Delta", "oman", None), (3, "Beta", None, None), (5, "Gamma", "Turkey", None)]


def test_has_country_is_country_first(spark):
    texts = ["from korea", "indiana", "the U.S.A.", "Türkiye", "xoman", "oman2", "New Oman", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.has_country(F.col("t")).alias("has"), X.country_first(F.col("t")).isNotNull().alias("first"), X.country_earliest(F.col("t")).isNotNull().alias("earliest")).collect()
    assert [bool(r.has) for r in rows] == [r.first for r in rows] == [r.earliest for r in rows] == [True, False, True, True, False, False, True, False, False]
