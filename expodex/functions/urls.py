"""URL algebra as Column expressions: lenient splitting by one regex, no UDF.

`try_parse_url` returns NULL for any URI that is not strictly valid, so parts come from a pattern
that takes what crawlers meet. Missing parts are empty strings, as are the results for NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def pieces(url: Column) -> Column:
    """[scheme, authority, path, ?query, #fragment] by one run of the pattern."""
    return F.split(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), _SPLIT, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001")


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.get(pieces(url), F.lit(k - 1)), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return F.substring(_part(url, 4), 2, 1 << 30)


def bare_host(url: Column, anywhere: bool = False) -> Column:
    """Host without a leading www.; anywhere=True removes the letters wherever they stand."""
    return F.replace(host(url), F.lit("www."), F.lit("")) if anywhere else F.regexp_replace(host(url), r"^www\.", "")


def registered_domain(name: Column) -> Column:
    """Last two labels of a host, three where the last two are a public suffix."""
    labels = F.split(F.regexp_replace(name, r":\d+$", ""), r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    longer = two.isin(D.TWO_LABEL_SUFFIXES) & (F.size(labels) >= 3)
    return F.when(F.size(labels) < 2, name).when(longer, F.array_join(F.slice(F.when(longer, labels).otherwise(F.array(F.lit(""), F.lit(""), F.lit(""))), -3, 3), ".")).otherwise(two)


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def path_depth(url: Column) -> Column:
    return F.size(segments(path(url)))


def pattern_key(url: Column) -> Column:
    """The first two path segments, the first, or `/`."""
    return F.concat(F.lit("/"), F.array_join(F.slice(segments(path(url)), 1, 2), "/"))


def cache_key(url: Column, length: int | None = None) -> Column:
    key = F.md5(F.lower(F.trim(url)))
    return F.substring(key, 1, length) if length else key


def without_dots(p: Column) -> Column:
    """Dot segments removed; a `..` at the root goes away."""
    kept = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.when(F.try_element_at(done, F.lit(1)) == "", 1).otherwise(0))))
        .otherwise(F.concat(done, F.array(s))),
    )
    closing = F.when(p.rlike(r"(^|/)\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), closing)


def _resolved(h: Column, p: Column, b: Column) -> Column:
    """h: trimmed href; p, b: pieces of href and base."""
    at = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(""))
    root = F.concat(F.lower(at(b, 0)), F.lit("://"), at(b, 1))
    folder = F.regexp_replace(at(b, 2), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    own, tail = at(p, 2), F.concat(at(p, 3), at(p, 4))
    return (
        F.when(h.isNull() | (h == ""), F.lit(""))
        .when(h.rlike(r"^(?i)https?://"), h)
        .when(h.startswith("//"), F.concat(F.lower(at(b, 0)), F.lit(":"), h))
        .when((at(p, 0) != "") | ~F.lower(at(b, 0)).isin("http", "https"), F.lit(""))
        .when(h.startswith("#"), F.concat(root, at(b, 2), at(b, 3), h))
        .when(h.startswith("?"), F.concat(root, at(b, 2), h))
        .when(h.startswith("/"), F.concat(root, F.when(own.contains("/."), without_dots(own)).otherwise(own), tail))
        .otherwise(F.concat(root, F.when(own.startswith(".") | own.contains("/."), without_dots(F.concat(folder, own))).otherwise(F.concat(folder, own)), tail))
    )


def resolved(href: Column, base: Column) -> Column:
    """href against base, as a browser would; other schemes than http(s) give an empty string."""
    h = F.trim(href)
    return let(F.struct(h.alias("h"), pieces(href).alias("p"), pieces(base).alias("b")), lambda s: _resolved(s["h"], s["p"], s["b"]))


def tidied(url: Column) -> Column:
    """Host lower-cased, trailing slashes and fragment removed; an empty string stays."""
    at = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(""))
    path_of = lambda p: F.when(at(p, 2) == "/", at(p, 2)).otherwise(F.regexp_replace(at(p, 2), "/+$", ""))
    query_of = lambda p: F.when(F.length(at(p, 3)) > 1, at(p, 3)).otherwise(F.lit(""))
    return let(pieces(url), lambda p: F.when(at(p, 0) == "", F.lit("")).otherwise(F.concat(F.lower(at(p, 0)), F.lit("://"), F.lower(at(p, 1)), path_of(p), query_of(p))))


def normalized(href: Column, base: Column) -> Column:
    """Resolved and tidied; empty if it is no http(s) URL."""
    return tidied(resolved(href, base))


def is_ignored(url: Column, on_path: bool = True) -> Column:
    """A path or scheme that is never followed; on_path=False tests patterns against the whole URL."""
    where = path(url) if on_path else url
    return F.lower(where).rlike("|".join(D.IGNORED_PATHS)) | F.lower(url).rlike("|".join(D.IGNORED_SCHEMES))


def has_ignored_extension(url: Column, extensions: list[str] = D.IGNORED_EXTENSIONS) -> Column:
    return F.lower(F.element_at(F.split(url, r"\?"), 1)).rlike(rf"\.({'|'.join(extensions)})$")


def is_pdf(url: Column) -> Column:
    return F.coalesce(F.lower(path(url)).endswith(".pdf"), F.lit(False))


def is_news(url: Column, domains: list[str] = D.NEWS_DOMAINS) -> Column:
    return D.suffix_match(bare_host(url, anywhere=True), domains)


def page_number(url: Column) -> Column:
    """Page number in the path or in the first paging parameter; NULL if there is none."""
    found = [F.try_to_number(F.nullif(F.regexp_extract(path(url), r"(?i)/page/(\d{1,9})/?$", 1), F.lit("")), F.lit("999999999")).cast("int")]
    for name in D.PAGE_PARAMS:
        found.append(F.nullif(F.regexp_extract(query(url), rf"(?i)(?:^|&){name}=(\d{{1,9}})(?:&|$)", 1), F.lit("")).cast("int"))
    return F.coalesce(*found)


def with_page(url: Column, number: Column) -> Column:
    """The same URL at another value of its `page` parameter."""
    return F.concat(F.regexp_replace(url, r"([?&]page=)\d+.*$", "$1"), number.cast("string"), F.regexp_extract(url, r"[?&]page=\d+(.*)$", 1))


def expanded_pages(url: Column, count: int = 50) -> Column:
    """Array of the next `count` pages after the one in the `page` parameter."""
    now = F.nullif(F.regexp_extract(query(url), r"(?:^|&)page=(\d{1,9})(?:&|$)", 1), F.lit("")).cast("int")
    return F.transform(F.sequence(now + 1, now + count), lambda k: with_page(F.regexp_replace(url, "#.*$", ""), k))


def engine_for_tld(name: Column) -> Column:
    tld = F.regexp_extract(name, r"([^.]+)$", 1)
    return F.when(tld == "cn", "baidu").when(tld.isin("ru", "su"), "yandex").when(tld == "jp", "yahoo").when(tld == "kr", "naver")


def safe_name(text: Column) -> Column:
    """A name for files: everything but letters, digits, dots, underscores and hyphens becomes an underscore."""
    return F.regexp_replace(text, r"[^a-zA-Z0-9._\-]", "_")


def engine(url: Column, country: Column, name: Column) -> Column:
    """The search engine for a company: by its site's country, its name's script, words of country and name, else google."""
    from . import text as X

    tld = F.when(F.lower(url).contains(".com.cn"), "baidu").otherwise(engine_for_tld(bare_host(url, anywhere=True)))
    return F.coalesce(tld, X.script_engine(name), X.keyword_engine(F.lower(F.concat_ws(" ", country, name))), F.lit("google"))
