"""Exhibitor lists from PDF text: piped tables and numbered blocks, within the arrays of a document's lines, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import text as X
from ..functions import urls as U
from .links import firsts
from .relational import computed

# Cells that make a header row, and lines that are no entries.
NAME_HEADERS = ["COMPANY NAME", "COMPANY", "EXHIBITOR", "EXHIBITOR NAME", "NAME", "FIRM", "PARTICIPANT", "EXHIBITOR/PARTICIPANT"]
NUMBER_HEADERS = ["NO.", "NO", "SR.NO.", "S.NO", "#", "NUMBER", "NUM", "SN"]
COUNTRY_HEADERS = ["COUNTRY", "NATION", "NATIONALITY"]
BOOTH_HEADERS = "BOOTH|STAND|HALL|PAVILION|STALL"
SKIPPED = r"(?i)EXHIBITOR LIST|PARTICIPATING COMPANIES|Updated as of|Country\s*/\s*Region|Exhibitor\s+Country|^Page \d+$|DEFENCE SERVICE|NATIONAL SECURITY|aca\s+Pav"
# End of fixed values.


def _country_of_cell(raw: Column) -> Column:
    """The first of the parts split by / , & that names a country, else the part before the first slash."""
    country = lambda p: F.coalesce(X.country_exact(p), X.country_first(F.lower(F.trim(p))))
    named = F.filter(F.transform(F.split(raw, "[/,&]"), country), lambda c: c.isNotNull())
    several = F.coalesce(F.try_element_at(named, F.lit(1)), F.trim(F.element_at(F.split(raw, "/"), 1)))
    return F.when(X.missing(raw).isNotNull(), F.when(raw.rlike("[/,&]"), several).otherwise(F.coalesce(country(raw), F.trim(raw))))


def documents(docs: DataFrame) -> DataFrame:
    """(url, markdown) with `doc`, a document's own name; a document that is repeated, URL and text, is one."""
    return docs.select("url", "markdown").dropDuplicates().withColumn("doc", F.xxhash64(F.lit(1), "url", "markdown"))


def _by(docs: DataFrame) -> list[str]:
    """What tells documents apart: their own name if they have one, else the URL."""
    return ["url", "doc"] if "doc" in docs.columns else ["url"]


def _confidence(weight: float) -> Column:
    return F.least(X.populated([F.col("name"), F.col("country"), F.col("booth_number")]) / F.lit(3.0), F.lit(1.0)) * F.lit(weight)


def _runs(items: Column, begins: Column) -> Column:
    """An array cut at ascending places: from each place up to the next one, or the end."""
    return F.transform(begins, lambda at, k: F.slice(items, at + 1, F.coalesce(F.get(begins, k + 1), F.size(items)) - at))


def table_rows(docs: DataFrame) -> DataFrame:
    """(url, markdown) -> url, line, name, country, booth_number, confidence_score; every row of docs is a document.

    Header rows carry forward to the next header; the first row of each name in a document stays.
    """
    by = _by(docs)
    lines = F.transform(F.split("markdown", "\n"), lambda x, k: F.struct(k.alias("line"), F.trim(x).alias("raw")))
    parts = lambda x: F.split(x["raw"], r"\|")
    cells = lambda parts: F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda c: F.trim(c))
    lines = F.transform(F.filter(lines, lambda x: F.startswith(x["raw"], F.lit("|"))), lambda x: F.struct(x["line"].alias("line"), x["raw"].alias("raw"), U.let(parts(x), cells).alias("cells")))
    lines = F.filter(lines, lambda x: F.exists(x["cells"], lambda c: (c != "") & ~c.rlike("^-+$")))
    names, lands = F.array(*[F.lit(h) for h in NAME_HEADERS]), F.array(*[F.lit(h) for h in COUNTRY_HEADERS])
    is_name, is_land = lambda c: F.array_contains(names, c), lambda c: F.array_contains(lands, c)

    def header(upper: Column) -> Column:
        last = lambda test: F.coalesce(F.array_max(F.filter(F.transform(upper, lambda c, k: F.when(test(c), k)), lambda k: k.isNotNull())), F.lit(-1))
        found = F.struct(last(is_name).alias("name"), last(is_land).alias("country"), last(lambda c: ~is_name(c) & ~is_land(c) & c.rlike(BOOTH_HEADERS)).alias("booth"))
        return F.when(F.exists(upper, is_name), found)

    def heads(lines: Column) -> Column:
        # A line without any of the words has no cell that is one.
        own = lambda x: F.when(F.upper(x["raw"]).rlike("|".join(NAME_HEADERS)), U.let(F.transform(x["cells"], lambda c: F.upper(c)), header))
        return F.filter(F.transform(lines, lambda x, k: F.struct(k.alias("at"), own(x).alias("header"))), lambda h: h["header"].isNotNull())

    def entry(x: Column, at: Column) -> Column:
        cell = lambda k: F.when(k >= 0, F.get(x["cells"], k))
        return F.struct(x["line"].alias("line"), cell(at["name"]).alias("name"), cell(at["country"]).alias("land"), X.missing(F.left(cell(at["booth"]), F.lit(60))).alias("booth_number"))

    below = lambda run, head: F.transform(F.slice(run, 2, F.size(run)), lambda x: entry(x, head["header"]))
    named = lambda e: (F.length(e["name"]) >= 2) & ~e["name"].rlike("^-+$") & ~F.upper(e["name"]).isin(NAME_HEADERS + NUMBER_HEADERS)
    under = lambda lines, heads: U.let(heads.getField("at"), lambda at: F.flatten(F.zip_with(_runs(lines, at), heads, below)))
    entries = U.let(lines, lambda lines: U.let(heads(lines), lambda heads: F.filter(under(lines, heads), named)))
    rows = docs.select(*by, F.explode(U.let(entries, lambda e: firsts(e, lambda e: F.lower(e["name"])))).alias("e")).select(*by, "e.*")
    rows = rows.select(*by, "line", "name", _country_of_cell(F.col("land")).alias("country"), "booth_number")
    return rows.withColumn("extraction_method", F.lit("pdf_table")).withColumn("confidence_score", _confidence(0.85))


def numbered_rows(docs: DataFrame, country_first: bool = True) -> DataFrame:
    """(url, markdown) -> one row for each numbered entry; blocks without a number continue the one before. Every row of docs is a document.

    country_first=False reads an all-capital country in the second column as a booth.
    """
    by = _by(docs)
    body = F.regexp_replace("markdown", r"(?s)^.*?Markdown Content:", "")
    blocks = F.transform(F.split(body, r"\n\n+"), lambda b, k: F.struct(k.alias("line"), F.trim(F.regexp_replace(F.trim(b), r"\s*\n\s*", " ")).alias("block")))
    docs = computed(docs.select(*by, "markdown"), blocks=F.filter(blocks, lambda b: (b["block"] != "") & ~b["block"].rlike(SKIPPED))).drop("markdown")
    docs = computed(docs, begins=F.filter(F.transform("blocks", lambda b, k: F.when(b["block"].rlike(r"^\d+\s{1,2}."), k)), lambda k: k.isNotNull()))
    own = lambda run: F.transform(run, lambda b, k: F.when(k == 0, F.regexp_replace(b["block"], r"^\d+\s{1,2}", "")).otherwise(b["block"]))
    entries = F.transform(_runs(F.col("blocks"), F.col("begins")), lambda run: F.struct(F.get(run, F.lit(0))["line"].alias("line"), F.array_join(own(run), "  ").alias("text")))
    rows = docs.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")
    rows = computed(rows, parts=F.filter(F.transform(F.split("text", r"\s{2,}"), lambda p: F.trim(p)), lambda p: p != ""))
    part = lambda k: F.try_element_at("parts", F.lit(k))
    rows = computed(rows, p1=part(1), p2=F.trim(F.regexp_replace(part(2), r"\s*\([^)]+\)\s*$", "")), p3=part(3)).drop("text", "parts")
    rows = rows.filter(F.length("p1").between(2, 200) & ~F.col("p1").rlike(r"^\d+$") & ~F.col("p1").rlike(SKIPPED))
    known = lambda c: F.coalesce(X.country_exact(c).isNotNull() | X.has_country(c), F.lit(False))
    coded = F.coalesce(F.col("p2").rlike(r"^[A-Z0-9][A-Za-z0-9_,\-\s]{0,15}$") & (F.length("p2") <= 12) & ~F.col("p2").rlike("[a-z]"), F.lit(False))
    second = F.when(known(F.col("p2")), "country").when(coded, "booth") if country_first else F.when(coded, "booth").when(known(F.col("p2")), "country")
    rows = computed(rows, second=F.when(F.col("p2").isNotNull(), F.coalesce(second, F.lit("name"))))
    name = F.when(F.col("second") == "name", F.trim(F.concat_ws(" ", "p1", "p2"))).otherwise(F.col("p1"))
    third = F.when(known(F.col("p3")) & ~(F.coalesce("second", F.lit("")) == "country"), "country").when((F.length("p3") <= 25) & ~(F.coalesce("second", F.lit("")) == "booth"), "booth")
    rows = computed(rows, name=name, third=third)
    country = F.coalesce(F.when(F.col("second") == "country", F.col("p2")), F.when(F.col("third") == "country", F.col("p3")), X.country_earliest(F.col("name")))
    booth = F.coalesce(F.when(F.col("second") == "booth", F.col("p2")), F.when(F.col("third") == "booth", F.col("p3")))
    rows = computed(rows, country=country, booth_number=X.missing(F.left(booth, F.lit(60)))).select(*by, "line", "name", "country", "booth_number")
    return rows.withColumn("extraction_method", F.lit("pdf_rule_based")).withColumn("confidence_score", _confidence(0.7))


def event_header(docs: DataFrame) -> DataFrame:
    """url, event_name, event_location, event_date from the first forty lines."""
    lines = F.filter(F.transform(F.slice(F.split("markdown", "\n"), 1, 40), lambda x: F.trim(F.regexp_replace(x, r"^[#*\s]+|[*\s]+$", ""))), lambda x: x != "")
    name = F.filter(lines, lambda x: F.length(x).between(6, 150) & ~x.startswith("|") & x.rlike("(?i)" + "|".join(D.TRADE_WORDS)))
    place = F.filter(lines, lambda x: x.rlike(r"(?i)^(venue|location|place|held at)\s*:"))
    months = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
    form = rf"(?i)(\d{{1,2}}(?:\s*[-–]\s*\d{{1,2}})?\s+(?:{months})[a-z]*\.?,?\s+\d{{4}}|(?:{months})[a-z]*\.?\s+\d{{1,2}}(?:\s*[-–]\s*\d{{1,2}})?,?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})"
    date = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, form, 1)), lambda x: x != "")
    first = lambda c: F.try_element_at(c, F.lit(1))
    return docs.select(*_by(docs), F.left(first(name), F.lit(200)).alias("event_name"), F.trim(F.regexp_replace(first(place), r"^[^:]*:", "")).alias("event_location"), first(date).alias("event_date"))


def vendors(docs: DataFrame, enough: int = 3) -> DataFrame:
    """Cascade of each document: its table if that has `enough` rows, else its numbered entries, else both.

    Documents that share a URL are read one by one; one that is repeated is read once.
    """
    held = documents(docs)
    table, numbered = table_rows(held), numbered_rows(held)
    n = table.groupBy("doc").agg(F.count("*").alias("n_table")).join(numbered.groupBy("doc").agg(F.count("*").alias("n_numbered")), "doc", "full")
    n = n.na.fill(0, ["n_table", "n_numbered"])
    from_table = table.join(n, "doc").filter(f"n_table >= {enough} or n_numbered < {enough}")
    from_numbered = numbered.join(n, "doc").filter(f"n_table < {enough}")
    out = from_table.unionByName(from_numbered).drop("n_table", "n_numbered")
    return out.join(event_header(held).drop("url"), "doc", "left").drop("doc").withColumnRenamed("url", "source_url").withColumnRenamed("line", "ord")
