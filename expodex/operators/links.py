"""Links of pages: extraction, scoring, candidates, vendor URLs and pagination, without any UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import scoring as S
from ..functions import urls as U
from .relational import computed


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.replace(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&"))


#: Operators that work within a page keep its anchors in one array, so nothing is shuffled.
ANCHOR = "ord int, href string, text string, title string, rel string, cls string, aria string, absolute string, url string"


def page_anchors(pages: DataFrame) -> DataFrame:
    """page_id, base, links: array of every <a href> in page order, one row a page.

    A null or empty page has an empty array; repeated rows each give their own.
    """

    def fields(a: Column, ord: Column) -> Column:
        def of(tag: Column) -> Column:
            href = _attribute(tag, "href")
            inner = F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", ""), r"\s+", " ")
            return F.struct(
                ord.alias("ord"), href.alias("href"), F.left(F.trim(inner), F.lit(200)).alias("text"), F.left(_attribute(tag, "title"), F.lit(100)).alias("title"),
                F.lower(_attribute(tag, "rel")).alias("rel"), _attribute(tag, "class").alias("cls"), _attribute(tag, "aria-label").alias("aria"), U.resolved(href, F.col("url")).alias("absolute"),
            )

        def whole(s: Column) -> Column:
            return F.struct(*[s[f].alias(f) for f in ("ord", "href", "text", "title", "rel", "cls", "aria", "absolute")], U.tidied(s["absolute"]).alias("url"))

        return U.let(U.let(F.regexp_extract(a, r"(?s)^<[^>]*>", 0), of), whole)

    found = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0)), fields)
    rows = computed(pages.select("page_id", F.col("url").alias("base"), "url", "html"), links=F.coalesce(found, F.array().cast(f"array<struct<{ANCHOR.replace(' ', ':').replace(',:', ',')}>>")))
    return rows.select("page_id", "base", F.filter("links", lambda a: a["href"] != "").alias("links"))


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, base, ord, href, text, title, rel, cls, aria, absolute, url of every <a href> in page order."""
    return page_anchors(pages).select("page_id", "base", F.explode("links").alias("a")).select("page_id", "base", "a.*")


def firsts(links: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of each key of an array, in order; linear, by a map of the places."""
    keyed = F.transform(links, lambda a, k: F.struct(key(a).alias("k"), k.alias("n")))
    # Sorted once and named: what a lambda's body builds itself is built again for every element.
    kept = U.let(F.array_sort(keyed), lambda places: F.filter(places, lambda p, k: (k == 0) | (F.get(places, k - 1)["k"] != p["k"])))
    return F.transform(F.array_sort(F.transform(kept, lambda p: p["n"])), lambda n: F.get(links, n))


def ranked(links: Column, order: Callable[[Column], list[Column]], most: int) -> Column:
    """The `most` least elements of an array by the order's values, each as (rank, a)."""
    keyed = F.transform(links, lambda a, k: F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order(a))], k.alias("n")))
    best = F.slice(F.array_sort(keyed), 1, most)
    return F.transform(best, lambda p, k: F.struct((k + 1).alias("rank"), F.get(links, p["n"]).alias("a")))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def page_links(pages: DataFrame, strong: list[str] = D.STRONG_KEYWORDS, medium: list[str] = D.MEDIUM_KEYWORDS, keep_news: bool = False) -> DataFrame:
    """page_id, base, links: normalised links of a page, the first of each URL, scored; ignored paths and news media go."""
    rows = page_anchors(pages)
    good = lambda a: (a["url"] != "") & ~U.is_ignored(a["url"]) if keep_news else (a["url"] != "") & ~U.is_ignored(a["url"]) & ~U.is_news(a["url"])
    rows = computed(rows, links=F.filter("links", good))
    rows = computed(rows, links=firsts(F.col("links"), lambda a: a["url"]), own=U.registered_domain(U.bare_host(F.col("base"))))
    scored = lambda a: F.struct(
        a["ord"].alias("ord"), a["url"].alias("url"), a["text"].alias("text"), a["title"].alias("title"), (U.registered_domain(U.bare_host(a["url"])) != F.col("own")).alias("is_external"),
        S.link_score(a["url"], a["text"], a["title"], strong, medium).alias("score"), S.link_reasons(a["url"], a["text"], a["title"], strong, medium).alias("score_reasons"), U.path_depth(a["url"]).alias("depth_hint"),
    )
    return computed(rows, links=F.transform("links", scored)).drop("own")


def links(pages: DataFrame, strong: list[str] = D.STRONG_KEYWORDS, medium: list[str] = D.MEDIUM_KEYWORDS, keep_news: bool = False) -> DataFrame:
    """page_links() as rows: page_id, base, ord, url, text, title, is_external, score, score_reasons, depth_hint."""
    return page_links(pages, strong, medium, keep_news).select("page_id", "base", F.explode("links").alias("a")).select("page_id", "base", "a.*")


def best_links(pages: DataFrame, threshold: int = 2, most: int = 500, **lists) -> DataFrame:
    """links() of at least `threshold`, best first within each page, ties in page order, with their rank; no shuffle."""
    rows = page_links(pages, **lists)
    good = F.filter("links", lambda a: a["score"] >= threshold)
    rows = computed(rows, links=ranked(good, lambda a: [-a["score"], a["ord"]], most))
    return rows.select("page_id", "base", F.explode("links").alias("r")).select("page_id", "base", "r.a.*", "r.rank")


def top_links(scored: DataFrame, threshold: int = 2, most: int = 500) -> DataFrame:
    """best_links() of rows that are not in page arrays: a window over each page_id."""
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "ord")
    return scored.filter(F.col("score") >= threshold).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def external_domains(scored: DataFrame, ignored: list[str] = D.IGNORED_DOMAINS, most: int = 200) -> DataFrame:
    """The first external link to each host of a page."""
    rows = scored.filter("is_external and score >= 0").withColumn("host", U.host(F.col("url"))).filter("host <> ''").filter(~D.suffix_match(F.col("host"), ignored))
    rows = first_by(rows, ["page_id", "host"], F.col("ord"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).filter(F.col("rank") <= most)


def list_pages(scored: DataFrame, strong: list[str] = D.STRONG_KEYWORDS, medium: list[str] = D.MEDIUM_KEYWORDS, most: int = 100) -> DataFrame:
    """Same-host candidates for exhibitor lists: one for each path, best total score first."""
    rows = scored.filter(U.host(F.col("url")) == U.host(F.col("base"))).withColumn("url_score", S.list_page_score(F.col("url"), F.col("text"), strong, medium)).filter("url_score > 0")
    rows = rows.withColumn("total_score", F.col("url_score") + F.col("score")).withColumn("path", F.regexp_replace(F.lower(U.path(F.col("url"))), "/+$", ""))
    rows = first_by(rows, ["page_id", "path"], F.desc("total_score"), F.col("ord"))
    order = Window.partitionBy("page_id").orderBy(F.desc("total_score"), "ord")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


#: Patterns that blocked() takes at most: they are collected into one expression.
MOST_PATTERNS = 10_000
#: Lengths of the pieces that patterns are looked up by.
GRAMS = (1, 2, 4, 8, 16)


def _collected(patterns: DataFrame) -> list[str]:
    """The distinct patterns, one more than MOST_PATTERNS at most."""
    return [r["pattern"] for r in patterns.select(F.lower("pattern").alias("pattern")).filter("pattern <> ''").distinct().limit(MOST_PATTERNS + 1).collect()]


def blocked(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """rows whose URL path holds none of the patterns, lower-cased; ValueError beyond MOST_PATTERNS of them. A null URL stays."""
    held = _collected(patterns)
    if len(held) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} blocked patterns")
    return rows.filter(~F.coalesce(holds_any(U.path(F.col("url")), held), F.lit(False)))


def not_blocked(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """blocked() of any number of patterns: one expression up to MOST_PATTERNS, an index that is joined beyond."""
    many = len(_collected(patterns)) > MOST_PATTERNS
    return without_patterns(rows, patterns) if many else blocked(rows, patterns)


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of that length, none if the text is shorter."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def pattern_index(patterns: DataFrame) -> DataFrame:
    """gram, pattern: every pattern (lower-cased, not empty) under one of its pieces, that which fewest patterns hold.

    The piece's length is the largest of GRAMS that fits, so a text holds the pattern only if it holds the piece.
    """
    own = patterns.select(F.lower("pattern").alias("pattern")).filter("pattern <> ''").distinct()
    pieces = F.when(F.length("pattern") >= GRAMS[-1], _grams(F.col("pattern"), GRAMS[-1]))
    for size in reversed(GRAMS[:-1]):
        pieces = pieces.when(F.length("pattern") >= size, _grams(F.col("pattern"), size))
    each = own.select("pattern", F.explode(pieces).alias("gram"))
    return each.join(each.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def texts_holding(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The distinct values of the column `text` that hold a pattern, exact: pieces are joined, then compared.

    Texts and patterns meet by equal pieces, so work follows the pieces they share, not their product; the index is
    broadcast only if Spark finds it small.
    """
    index = pattern_index(patterns)
    sizes = sorted(r["n"] for r in index.select(F.length("gram").alias("n")).distinct().collect())  # of GRAMS
    none = F.array().cast("array<string>")
    pieces = F.concat(none, *[_grams(F.col("text"), n) for n in sizes])
    each = texts.select("text").filter("text is not null").distinct().select("text", F.explode(pieces).alias("gram"))
    return each.join(index, "gram").filter(F.col("text").contains(F.col("pattern"))).select("text").distinct()


def without_patterns(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """blocked() by an index of the patterns; rows are shuffled by their path."""
    marked = rows.withColumn("__path", F.lower(U.path(F.col("url"))))
    gone = texts_holding(marked.select(F.col("__path").alias("text")), patterns).withColumnRenamed("text", "__path")
    return marked.join(gone, "__path", "left_anti").drop("__path")


def holds_any(path: Column, patterns: list[str]) -> Column:
    """Whether the path, lower-cased, holds one of the words."""
    return F.lower(path).rlike("|".join("".join("\\" + c if c in ".^$*+?()[]{}|\\-" else c for c in p) for p in sorted(patterns))) if patterns else F.lit(False)


def runs(rows: Column, key: Callable[[Column], Column], made: Callable[[Column], Column]) -> Column:
    """made(the elements of each key) for every key of an array, in the order of the keys; linear after one sort.

    key: a value that is never null; elements of a key keep the array's order.
    """
    places = F.array_sort(F.transform(rows, lambda a, k: F.struct(key(a).alias("k"), k.alias("n"))))

    def cut(placed: Column) -> Column:
        starts = F.filter(F.transform(placed, lambda p, k: F.when((k == 0) | (F.get(placed, k - 1)["k"] != p["k"]), k)), lambda k: k.isNotNull())
        return U.let(starts, lambda at: F.transform(at, lambda k, i: made(F.transform(F.slice(placed, k + 1, F.coalesce(F.get(at, i + 1), F.size(placed)) - k), lambda p: F.get(rows, p["n"])))))

    return U.let(places, cut)


def vendor_urls(
    pages: DataFrame, sitemap: DataFrame | None = None, words: list[str] = D.VENDOR_PATH_KEYWORDS, navigation: list[str] = D.NAV_PATH_KEYWORDS, patterns: DataFrame | None = None, most: int = 100, group: int = 3
) -> DataFrame:
    """Profile URLs of listing pages: keywords in the path, +5 for every occurrence in a repeated prefix,
    +8 for a place in the site's own sitemap (page_id, url). Long queries (over 30 characters) are no profiles.

    Occurrences, prefixes and the sitemap are counted within a page's array by sorting it, so the work is linear (but for the sort)
    in a page's links and in its sitemap.
    """
    short = r"/+$"

    def good(a: Column) -> Column:
        own = U.host(a["absolute"]).contains(U.host(F.col("base"))) & (F.regexp_replace(a["absolute"], short, "") != F.regexp_replace("base", short, ""))
        return (a["absolute"] != "") & ~F.startswith(F.trim(a["href"]), F.lit("#")) & own & (F.length(U.query(a["absolute"])) <= 30) & ~S.is_navigation(a["absolute"], navigation)

    rows = computed(page_anchors(pages), links=F.filter("links", good))
    each = lambda a: F.struct(a["absolute"].alias("url"), a["ord"].alias("ord"), F.lit(1).alias("times"), F.lit(False).alias("listed"))
    rows = computed(rows, links=F.transform("links", each))
    none = F.expr("cast(array() as array<struct<url:string,ord:int,times:int,listed:boolean>>)")
    if patterns is not None:  # as rows, since there may be any number of patterns
        kept = not_blocked(rows.select("page_id", F.explode("links").alias("a")).select("page_id", "a.*"), patterns)
        rows = kept.groupBy("page_id").agg(F.collect_list(F.struct("url", "ord", "times", "listed")).alias("links"))
    if sitemap is not None:
        listed = sitemap.filter("url is not null").groupBy("page_id").agg(F.collect_set("url").alias("sitemap"))
        told = F.transform(F.coalesce("sitemap", F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit(-1).alias("ord"), F.lit(0).alias("times"), F.lit(True).alias("listed")))
        rows = rows.select("page_id", "links").join(listed, "page_id", "full").select("page_id", F.concat(F.coalesce("links", none), told).alias("links"))
    total = lambda group, f: F.aggregate(group, F.lit(0), lambda n, a: n + a[f])
    place = lambda group: F.array_min(F.transform(group, lambda a: a["ord"]))
    by_url = lambda g: F.struct(F.get(g, 0)["url"].alias("url"), place(g).alias("ord"), total(g, "times").alias("times"), F.exists(g, lambda a: a["listed"]).alias("listed"))
    rows = computed(rows, links=runs(F.col("links"), lambda a: a["url"], by_url))
    rows = computed(rows, links=F.transform("links", lambda a: F.struct(U.pattern_key(a["url"]).alias("prefix"), S.vendor_path_score(a["url"], words).alias("by_path"), a.alias("a"))))

    def scored(g: Column) -> Column:
        often = F.aggregate(g, F.lit(0), lambda n, b: n + b["a"]["times"]) >= group
        score = lambda b: F.when(b["a"]["listed"], 8).otherwise(b["by_path"]) + F.when(often, 5 * b["a"]["times"]).otherwise(0)
        return F.transform(g, lambda b: F.struct(b["a"]["url"].alias("url"), score(b).cast("long").alias("score"), b["a"]["ord"].alias("ord")))

    found = computed(rows, found=F.flatten(runs(F.col("links"), lambda b: b["prefix"], scored)))
    best = computed(found, best=ranked(F.filter("found", lambda a: a["score"] > 0), lambda a: [-a["score"], a["ord"], a["url"]], most))
    return best.select("page_id", F.explode("best").alias("r")).select("page_id", "r.a.url", "r.a.score", "r.rank")


def profile_urls(links: DataFrame, words: list[str] = D.VENDOR_PATH_KEYWORDS, navigation: list[str] = D.NAV_PATH_KEYWORDS, group: int = 3, longest_query: int = 40, most: int | None = None) -> DataFrame:
    """(ord, base, url) of a listing's links -> base, url, score: the simpler score of profile pages.

    +3 for each keyword in the path, +5 once for a prefix shared by `group` URLs; other hosts, navigation
    and long queries go; a URL counts once.
    """
    rows = links.filter((U.host(F.col("url")) == U.host(F.col("base"))) & (F.length(U.query(F.col("url"))) <= longest_query) & ~S.is_navigation(F.col("url"), navigation))
    rows = rows.groupBy("base", "url").agg(F.min("ord").alias("ord")).withColumn("prefix", U.pattern_key(F.col("url")))
    groups = rows.groupBy("base", "prefix").agg(F.count("*").alias("n"))
    rows = rows.join(groups, ["base", "prefix"]).withColumn("score", S.vendor_path_score(F.col("url"), words) + F.when(F.col("n") >= group, 5).otherwise(0))
    out = rows.filter("score > 0").select("base", "url", "score", "ord").orderBy(F.desc("score"), "ord")
    return (out if most is None else out.limit(most)).drop("ord")


def sitemap_vendor_urls(locs: DataFrame, words: list[str] = D.VENDOR_PATH_KEYWORDS, navigation: list[str] = D.NAV_PATH_KEYWORDS) -> DataFrame:
    """(site, ord, url) -> those of the site whose path has a vendor keyword and no navigation one, the first of each."""
    rows = locs.filter(U.host(F.col("url")).contains(F.col("site"))).filter(S.vendor_path_score(F.col("url"), words) > 0).filter(~S.is_navigation(F.col("url"), navigation))
    return first_by(rows, ["site", "url"], F.col("ord"))


def pagination(pages: DataFrame, most: int = 20) -> DataFrame:
    """page_id, number, url: pages 2 to the highest page number among a page's own links, `most` at most."""
    rows = anchors(pages).withColumn("url", F.col("absolute")).filter(U.host(F.col("url")).contains(U.host(F.col("base"))))
    in_path = U.path(F.col("url")).rlike(r"(?i)/page/\d+/?$")
    rows = rows.withColumn("number", U.page_number(F.col("url"))).withColumn("style", F.when(in_path, "path").otherwise("query")).filter("number > 1")
    params = "|".join(D.PAGE_PARAMS)
    rows = rows.withColumn("param", F.regexp_extract(U.query(F.col("url")), rf"(?i)(?:^|&)({params})=\d+", 1))
    top = first_by(rows, ["page_id"], F.desc("number"), F.col("ord"))
    base = F.regexp_replace("base", "#.*$", "")
    bare = F.regexp_replace(U.path(base), r"(?i)/page/\d+/?$", "")
    pages_ = top.select("page_id", "base", "style", "param", F.explode(F.sequence(F.lit(2), F.least(F.col("number"), F.lit(most)))).alias("number"))
    root = F.concat(U.scheme(base), F.lit("://"), U.host(base))
    q = F.when(U.query(base) != "", F.concat(F.lit("?"), U.query(base))).otherwise(F.lit(""))
    by_path = F.concat(root, F.regexp_replace(bare, "/+$", ""), F.lit("/page/"), F.col("number").cast("string"), F.lit("/"), q)
    others = F.filter(F.split(U.query(base), "&"), lambda kv: (kv != "") & (F.lower(F.element_at(F.split(kv, "="), 1)) != F.lower(F.col("param"))))
    by_query = F.concat(root, U.path(base), F.lit("?"), F.array_join(F.concat(others, F.array(F.concat(F.col("param"), F.lit("="), F.col("number").cast("string")))), "&"))
    return pages_.select("page_id", "number", F.when(F.col("style") == "path", by_path).otherwise(by_query).alias("url"))


def next_links(pages: DataFrame, glyphs: bool = True) -> DataFrame:
    """page_id, next_url: the first link marked as leading on; bare arrows count unless glyphs is False."""
    rows = anchors(pages)
    word = F.col("text").rlike(r"(?i)(^|[^A-Za-z0-9_])(next|selanjutnya|next page)([^A-Za-z0-9_]|$)")
    if glyphs:
        word = word | F.col("text").rlike("^(>|›|»|&gt;|&rsaquo;|&raquo;)$")
    marked = word | F.col("cls").rlike("(?i)next|forward|arrow-right") | F.col("aria").rlike("(?i)next") | F.array_contains(F.split("rel", r"\s+"), "next")
    rows = rows.filter(marked).withColumnRenamed("url", "next_url").filter("next_url <> '' and next_url <> base")
    return first_by(rows, ["page_id"], F.col("ord")).select("page_id", "next_url")


def prefix_groups(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prefix", U.pattern_key(F.col("url"))).groupBy("prefix").agg(F.count("*").alias("n"))
