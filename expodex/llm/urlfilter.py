"""URL filtering: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

The automaton counts strict and soft terms in the whole URL (A-Z folded); a hit stands only between
boundaries, that is, no ASCII letter or digit next to it. One strict term, or at least SOFT_LIMIT
distinct soft terms, reject the URL. A rule that fits decides instead, the longest one first.

Defined results: a null URL, or one without `://`, has an empty host and path and meets no rule; a
null URL is allowed; repeated rows are judged alike; URLs of any length are read whole; ties cannot
occur between rules of equal length on one URL unless they are equal; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rules of the contract, (host, path) -> verdict.
RULES = {("org", "/"): "allow", ("example.org", "/es/"): "block", ("example.org", "/en/1"): "block", ("com", "/fr/"): "allow", ("com", "/de/"): "block"}
STRICT = ["adult", "casino", "escort", "gambling", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx"]
SOFT = ["ads", "bet", "bets", "bonus", "cheap", "crack", "dating", "farm", "free", "jackpot", "keygen", "loan", "nude", "payday", "pills", "poker", "popup", "replica", "sex", "slots", "torrent", "track", "win"]
SOFT_LIMIT = 2
_FOLD = {c: c + 32 for c in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


class Vocabulary:
    def __init__(self, strict: list[str] = STRICT, soft: list[str] = SOFT, soft_limit: int = SOFT_LIMIT):
        import ahocorasick

        self.automaton, self.soft_limit = ahocorasick.Automaton(), soft_limit
        for kind, terms in (("soft", soft), ("strict", strict)):
            for term in terms:
                self.automaton.add_word(term, (kind, term))
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[int, int]:
        """(strict terms, soft terms) that occur, each counted once."""
        url = url.translate(_FOLD)
        found = set()
        for end, own in self.automaton.iter(url):
            before, after = end - len(own[1]), end + 1
            if (before < 0 or url[before] not in _WORD) and (after == len(url) or url[after] not in _WORD):
                found.add(own)
        return sum(k == "strict" for k, _ in found), sum(k == "soft" for k, _ in found)


def host_and_path(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


def rule_for(host: str, path: str, by_host: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    best = None
    labels = host.split(".")
    for k in range(len(labels)):
        for start, name, verdict in by_host.get(".".join(labels[k:]), ()):
            if path.startswith(start) and (best is None or len(name) > len(best[0])):
                best = name, verdict
    return best


def judged(pages: DataFrame, rules: dict[tuple[str, str], str] = RULES, vocabulary: dict | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft for every row of pages."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for (host, start), verdict in rules.items():
        by_host.setdefault(host, []).append((start, host + start, verdict))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Vocabulary(**(vocabulary or {}))
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for url in batch.column("url").to_pylist():
                host, path = host_and_path(url)
                rule = rule_for(host, path, by_host) if host else None
                strict, soft = terms.hits(url or "")
                verdict = rule[1] if rule else "block" if strict or soft >= terms.soft_limit else "allow"
                for column, value in zip(out, (host, path, rule and rule[0], verdict, strict, soft), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(c, pa.string()) for c in out[:4]), *(pa.array(c, pa.int64()) for c in out[4:])],
                names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"],
            )

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long"
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    terms = lambda words: " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){w}($|[^a-z0-9])')::BIGINT" for w in words)
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for (h, p), v in RULES.items())
    return f"""
WITH r(rh, rp, rv) AS (VALUES {rules}),
s AS (SELECT page_id, {fold.format("coalesce(url, '')")} AS u,
        CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^#?]*', 0) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, u, {fold.format("regexp_extract(rest, '^[^/]*', 0)")} AS host,
        CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path, row_number() OVER () AS k FROM s),
f AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM p JOIN r ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k),
c AS (SELECT p.*, rule, rv, {terms(STRICT)} AS n_strict, {terms(SOFT)} AS n_soft FROM p LEFT JOIN f USING (k))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN rv WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM c
"""
