"""Text, contact and record scalars as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"


def clean(text: Column, most: int = 500) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " ")), F.lit(most))


def missing(text: Column) -> Column:
    """NULL for NULL and blank."""
    return F.when(F.trim(text) != "", text)


def key_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_]", "_"), "^_+|_+$", "")


def count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def sanitized(text: Column) -> Column:
    """A cell without control characters; binary leaks become empty."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), CONTROL, "")
    beyond = count_of(t, r"[^\x00-\x7f]")
    real = count_of(t, r"[\x{00C0}-\x{024F}\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]")
    bad = (F.length(t) > 10) & (beyond / F.greatest(F.length(t), F.lit(1)) > 0.30) & (real < beyond * 0.5)
    return F.left(F.when(bad, F.lit("")).otherwise(t), F.lit(32767))


def is_readable(text: Column) -> Column:
    return F.coalesce((F.length(text) >= 3) & (count_of(text, r"[\x00-\x1f\x7f-\x9f]") / F.greatest(F.length(text), F.lit(1)) <= 0.05), F.lit(False))


_PUNCT = r".,;:!?\-'\"()（）【】。，、：；！？…—·"


def looks_like_text(text: Column) -> Column:
    size = F.greatest(F.length(text), F.lit(1))
    mostly = count_of(text, r"[\p{L} ]") / size >= 0.60
    token = rf"^[\p{{L}}{_PUNCT}]{{2,}}$"
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.rlike(token))
    whole = F.regexp_replace(text, " ", "").rlike(token)
    one = F.when(F.size(tokens) == 0, F.when(whole, F.length(text))).when(F.size(tokens) == 1, F.length(F.try_element_at(tokens, F.lit(1))))
    return F.coalesce((F.length(text) >= 8) & mostly & ((F.size(tokens) >= 2) | F.coalesce(one >= 4, F.lit(False))), F.lit(False))


def clean_field(text: Column, free_text: bool = False) -> Column:
    """Without control characters; NULL if unreadable, or if free text that does not look like text."""
    t = F.trim(F.regexp_replace(text, CONTROL, ""))
    ok = is_readable(t)
    if free_text:
        ok = ok & ((F.length(t) <= 10) | looks_like_text(t))
    return F.when(ok, t)


def company_key(name: Column) -> Column:
    """Lower-cased, without legal forms and without everything but a-z, 0-9 and blanks."""
    n = F.lower(F.trim(name))
    n = F.regexp_replace(n, rf"(?<![a-z0-9_])({'|'.join(D.LEGAL_SUFFIXES)})(?![a-z0-9_])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(n, r"[^a-z0-9\s]", ""), r"\s+", " "))


def _all_of(text: Column, pattern: str, needs: Column) -> Column:
    """All matches of a pattern, which is only tried where what every match needs is there; NULL for NULL."""
    none = F.array().cast("array<string>")
    return F.when(text.isNotNull(), F.when(needs, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))


def emails(text: Column, most: int = 3, unwanted: str = "example|noreply|no-reply") -> Column:
    found = F.transform(_all_of(text, rf"(?<![A-Za-z0-9_]){D.EMAIL}", text.contains("@")), lambda e: F.regexp_replace(F.lower(e), "^[.,;]+|[.,;]+$", ""))
    return F.slice(F.array_distinct(F.filter(found, lambda e: ~e.rlike(unwanted))), 1, most)


def phones(text: Column, most: int = 2) -> Column:
    found = F.transform(_all_of(text, D.PHONE, text.rlike("[0-9]{3}")), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(found, lambda p: count_of(p, "[0-9]") >= 7)), 1, most)


def linkedin(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"https?://(?:www\.)?linkedin\.com/company/[A-Za-z0-9\-_]+", 0), F.lit(""))


def twitter(text: Column) -> Column:
    name = F.regexp_extract(text, rf"https?://(?:www\.)?(?:twitter\.com|x\.com)/(?!{'|'.join(D.TWITTER_PAGES)})([A-Za-z0-9_]{{1,50}})(?:[/?]|$)", 1)
    return F.when(name != "", F.concat(F.lit("https://twitter.com/"), name))


def booth(text: Column) -> Column:
    return F.nullif(F.left(F.trim(F.regexp_extract(text, r"(?i)((?:hall|stand|booth)\s*(?:no\.?|number)?\s*[:#]?\s*[A-Z0-9][A-Z0-9\-./]*(?:\s*\|\s*(?:hall|stand|booth)\s*[:#]?\s*[A-Z0-9][A-Z0-9\-./]*)?)", 1)), F.lit(60)), F.lit(""))


def amount(text: Column, unit: str = "") -> Column:
    """The first number of a text without its commas, with a unit if one is given."""
    n = F.regexp_replace(F.regexp_extract(text, r"([\d,.]*\d)", 1), ",", "")
    return F.when(n != "", F.concat(n, F.lit(unit)))


def city_of_address(address: Column) -> Column:
    parts = F.split(address, ",")
    return F.when(F.size(parts) >= 2, F.trim(F.try_element_at(parts, F.lit(-2))))


def title_name(title: Column) -> Column:
    """The part of a page title before its first separator, if it is of 2 to 100 characters."""
    part = F.trim(F.element_at(F.split(title, r" \| | - | — | – "), 1))
    return F.when(F.length(part).between(2, 100), part)


def no_heading(name: Column) -> Column:
    """NULL for what is a section's heading, not a name."""
    return F.when(~F.trim(name).rlike(rf"(?i)^({D.SECTION_HEADINGS})$"), name)


def without_heading(text: Column) -> Column:
    """Free text without the heading word that was joined to its front."""
    return F.trim(F.regexp_replace(text, rf"(?i)^(?:{D.HEADING_PREFIXES})\s*", ""))


def unnumbered(name: Column) -> Column:
    """A list entry without its number: `1. Acme`, `(2) Acme`."""
    return F.trim(F.regexp_replace(name, r"^\s*(?:\(\d+\)|\d+[.)])\s*", ""))


def core_query(text: Column) -> Column:
    return F.trim(F.left(F.trim(F.element_at(F.split(text, ","), 1)), F.lit(100)))


def tags_removed(html: Column, density: bool = False) -> Column:
    h = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ") if density else html
    return F.trim(F.regexp_replace(F.regexp_replace(h, r"(?s)<[^>]+>", " "), r"\s+", " "))


def keyword_count(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def page_date(text: Column) -> Column:
    short = F.length(text) < 100
    pattern = r"(^|[^A-Za-z0-9_])(\d{1,2}[\s\-/][A-Za-z0-9_]+[\s\-/]\d{2,4}|[A-Za-z0-9_]+\s+\d{1,2}[-–]\d{1,2},?\s*\d{4}|\d{4})([^A-Za-z0-9_]|$)"
    return F.when(short & text.rlike(pattern), F.left(text, F.lit(80)))


def language(lang: Column, text: Column) -> Column:
    """The declared language, else by script of the first thousand characters."""
    declared = F.lower(F.element_at(F.split(F.coalesce(lang, F.lit("")), "-"), 1))
    sample = F.left(text, F.lit(1000))
    return (
        F.when(declared != "", declared)
        .when(count_of(sample, r"[\x{4e00}-\x{9fff}]") > 5, "zh")
        .when(count_of(sample, r"[\x{0400}-\x{04ff}]") > 5, "ru")
        .otherwise("unknown")
    )


def script_engine(name: Column) -> Column:
    return (
        F.when(name.rlike(r"[\x{4e00}-\x{9fff}]"), "baidu")
        .when(name.rlike(r"[\x{0400}-\x{04ff}]"), "yandex")
        .when(name.rlike(r"[\x{3040}-\x{30ff}]"), "yahoo")
        .when(name.rlike(r"[\x{ac00}-\x{d7a3}]"), "naver")
    )


def keyword_engine(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike("|".join(words)), F.lit(engine)) for engine, words in D.ENGINE_WORDS])


def country_exact(text: Column) -> Column:
    return F.try_element_at(D.map_of(D.COUNTRIES), F.lower(F.trim(text)))


def _alias_pattern() -> str:
    """Group 1: an alias as a whole word; of several at one place the first in the table's order. Aliases are tried by their first letter only."""
    by: dict[str, list[str]] = {}
    for a in D.COUNTRIES:
        by.setdefault(a[0], []).append(a[1:])
    either = "|".join(f"{_escaped(c)}(?:{'|'.join(_escaped(a) for a in rest)})(?![\\p{{L}}\\p{{N}}_])" for c, rest in by.items())
    return rf"(?=[{''.join(_escaped(c) for c in by)}])(?<![\p{{L}}\p{{N}}_])(?=({either}))"


def _aliases(text: Column) -> Column:
    """The aliases that stand in the text as whole words, by the place where they begin (one a place)."""
    return F.regexp_extract_all(F.lower(text), F.lit(_alias_pattern()), F.lit(1))


def has_country(text: Column) -> Column:
    """Whether any alias stands in the text as whole words."""
    return F.lower(text).rlike(_alias_pattern())


def country_first(text: Column) -> Column:
    """Country of the first alias, in the table's order, that stands in the text as whole words."""
    order = D.map_of({a: k for k, a in enumerate(D.COUNTRIES)})
    names = F.array(*[F.lit(c) for c in D.COUNTRIES.values()])
    return F.get(names, F.array_min(F.transform(_aliases(text), lambda a: F.try_element_at(order, a))))


def country_earliest(text: Column) -> Column:
    """Country of the alias that begins earliest in the text."""
    return F.try_element_at(D.map_of(D.COUNTRIES), F.regexp_extract(F.lower(text), _alias_pattern(), 1))


def _escaped(word: str) -> str:
    return "".join("\\" + c if c in ".^$*+?()[]{}|\\-" else c for c in word)


def valid_name(name: Column, translate: Callable[[Column], Column] = lambda c: c) -> Column:
    """A plausible company name, else NULL; names in Chinese or Cyrillic script are translated before they are judged."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    n = F.when(n.rlike(r"[\x{4e00}-\x{9fff}\x{0400}-\x{04ff}]"), F.coalesce(missing(translate(n)), n)).otherwise(n)
    slashes = count_of(n, "/")
    bad = (
        (F.length(n) < 2)
        | (F.length(n) > 300)
        | n.rlike(r"^\d+$")
        | n.rlike(f"(?i)^({D.BAD_NAME_WORDS})$")
        | (F.size(F.split(n, " ")) > 10)
        | n.rlike(r"(?i)(^|[^A-Za-z0-9_])(series|zone|pavilion|sector|segment|division|corridor|gallery|court)\s*$")
        | (slashes >= 2)
        | ((slashes == 1) & (F.length(n) <= 40) & ~n.rlike(r"[A-Z][a-z]{2,}.*[A-Z][a-z]{2,}"))
    )
    return F.when(~bad, n)


def valid_email(e: Column) -> Column:
    return F.when(e.rlike(f"^{D.EMAIL}"), e)


def valid_website(w: Column) -> Column:
    host = F.replace(F.lower(F.regexp_extract(w, r"^https?://([^/?#]*)", 1)), F.lit("www."), F.lit(""))
    social = reduce(lambda a, b: a | b, [host.contains(s) for s in D.SOCIAL_DOMAINS])
    return F.when(w.rlike("^https?://") & (F.length(w) <= 200) & ~social, w)


def valid_phone(p: Column) -> Column:
    return F.when(count_of(p, "[0-9]").between(7, 20), p)


def valid_country(c: Column) -> Column:
    return F.coalesce(country_exact(c), country_first(c), F.left(F.trim(missing(c)), F.lit(100)))


def valid_description(d: Column) -> Column:
    return F.when(F.length(d) >= 20, F.left(d, F.lit(1000)))


def populated(fields: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(f, F.lit("")) != "", 1).otherwise(0) for f in fields])


def confidence(record: dict[str, Column]) -> Column:
    """Share of the nine core fields, capped without a contact, less penalties for poor descriptions."""
    own = {k: F.coalesce(v, F.lit("")) for k, v in record.items()}
    score = populated([own[k] for k in D.CORE_FIELDS]) / F.lit(9.0)
    contact = (own["email"] != "") | (own["phone"] != "") | (own["website"] != "")
    score = F.when(contact, score).otherwise(F.least(score, F.lit(0.35)))
    low = F.lower(own["description"])
    junk = reduce(lambda a, b: a | b, [low.contains(w) for w in D.JUNK_DESCRIPTIONS])
    score = score - F.when(junk, 0.20).otherwise(0.0) - F.when((low != "") & (F.length(low) < 50), 0.10).otherwise(0.0)
    return F.when(F.trim(own["name"]) == "", F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 3))
