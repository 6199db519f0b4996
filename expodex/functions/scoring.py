"""Relevance scores of links, seeds and pages; keyword lists are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D
from . import urls as U


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def weighed(first: Column, second: Column, words: list[str], in_first: int, in_second: int) -> Column:
    """in_first for each word that `first` holds, else in_second for each that `second` holds."""
    return _total([F.when(first.contains(w), in_first).when(second.contains(w), in_second).otherwise(0) for w in words])


def _texts(url: Column, text: Column, title: Column) -> Column:
    """struct(u, every, depth): the lower-cased URL, all that is said, and the depth of the path."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.struct(F.lower(url).alias("u"), F.concat_ws(" ", F.lower(url), low(text), low(title)).alias("every"), U.path_depth(url).alias("depth"))


def link_score(url: Column, text: Column, title: Column, strong: list[str] = D.STRONG_KEYWORDS, medium: list[str] = D.MEDIUM_KEYWORDS, news: list[str] = D.NEWS_DOMAINS) -> Column:
    def of(s: Column) -> Column:
        score = weighed(s["u"], s["every"], strong, 5, 2) + weighed(s["u"], s["every"], medium, 3, 1)
        return score + F.when(s["u"].rlike(r"/page/\d+|[?&]page=\d+"), 2).otherwise(0) + F.when(s["depth"] == 1, 1).when(s["depth"] >= 4, -1).otherwise(0)

    return F.when(U.is_news(url, news), F.lit(-10)).otherwise(U.let(_texts(url, text, title), of))


def link_reasons(url: Column, text: Column, title: Column, strong: list[str] = D.STRONG_KEYWORDS, medium: list[str] = D.MEDIUM_KEYWORDS, most: int = 5) -> Column:
    def of(s: Column) -> Column:
        said = [F.when(s["u"].contains(w), F.lit(f"url_{kind}:{w}")).when(s["every"].contains(w), F.lit(f"text_{kind}:{w}")) for kind, words in (("strong", strong), ("medium", medium)) for w in words]
        said.append(F.when(s["u"].rlike(r"/page/\d+|[?&]page=\d+"), F.lit("pagination")))
        return F.slice(F.array_compact(F.array(*said)), 1, most)

    return F.when(U.is_news(url), F.array(F.lit("news_media_blocked"))).otherwise(U.let(_texts(url, text, title), of))


def list_page_score(url: Column, text: Column, strong: list[str] = D.STRONG_KEYWORDS, medium: list[str] = D.MEDIUM_KEYWORDS) -> Column:
    low = F.struct(F.lower(url).alias("u"), F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    return U.let(low, lambda s: weighed(s["u"], s["t"], strong, 8, 4) + weighed(s["u"], s["t"], medium, 4, 2))


def simple_score(url: Column, text: Column, words: list[str]) -> Column:
    """+2 for a word in the URL, +1 for one in the text, both counting."""
    low = F.struct(F.lower(url).alias("u"), F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    return U.let(low, lambda s: _total([F.when(s["u"].contains(w), 2).otherwise(0) + F.when(s["t"].contains(w), 1).otherwise(0) for w in words]))


def seed_score(url: Column, title: Column, snippet: Column) -> Column:
    has = lambda c, words: reduce(lambda a, b: a | b, [c.contains(w) for w in words])
    low = F.struct(F.lower(url).alias("u"), F.lower(F.concat_ws(" ", url, F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))).alias("every"), U.host(url).alias("host"))

    def of(s: Column) -> Column:
        score = _total([F.when(s["every"].contains(w), n).otherwise(0) for words, n in ((D.SEED_KEYWORDS_3, 3), (D.SEED_KEYWORDS_2, 2), (D.SEED_TOPICS, 1)) for w in words])
        score = score + F.when(has(s["host"], D.EVENT_DOMAINS), 5).otherwise(0)
        return score + F.when(has(s["u"], ["exhibitor", "vendor", "directory", "sponsor"]), 4).otherwise(0) + F.when(has(s["u"], ["list", "directory"]), 2).otherwise(0)

    return U.let(low, of)


def vendor_path_score(url: Column, words: list[str] = D.VENDOR_PATH_KEYWORDS) -> Column:
    return U.let(F.lower(U.path(url)), lambda p: _total([F.when(p.contains(w), 3).otherwise(0) for w in words]))


def is_navigation(url: Column, words: list[str] = D.NAV_PATH_KEYWORDS) -> Column:
    return F.lower(U.path(url)).rlike("|".join(words)) if words else F.lit(False)
