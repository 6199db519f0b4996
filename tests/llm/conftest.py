import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, band long"

LONG = " ".join(f"w{k % 977} x{k % 31}" for k in range(20000))
ODD = [
    (1, None, "en", None, None, 1.0, 1),
    (2, "", None, "a", 0, None, None),
    (3, " \t\n ", "en", "a", 4, 0.5, 2),
    (4, "the", "en", "a", 3, 0.5, 2),
    (5, "the", "en", "a", 3, 0.5, 2),
    (5, "the", "en", "a", 3, 0.5, 2),
    (None, "a row without any number", "en", "b", 1, 0.5, 2),
    (7, LONG, "en", "b", len(LONG), 0.5, 2),
    (8, "Ünï çödé 日本語 \U0001f642 ñandú", "es", "b", 9, 0.5, 2),
    (9, "a" * 30000, "en", "c", 30000, 0.5, 2),
    (10, "!!! --- 123 ???", "en", "c", 15, 0.5, 2),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, ties, repeated rows, very long texts, extra columns named like the operators' own."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
