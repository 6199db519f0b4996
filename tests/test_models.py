"""Parsers in processes, tables with one row a key, frontiers of any size, listings by a model."""

import json
import re
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from expodex import keyed
from expodex.operators import frontier, listings, parsers

PAGES = "page_id long, url string, html string"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the parsers below travel whole


def fine(html):
    return [{"name": n, "size": len(html), "none": None} for n in html.split(",") if n] + ["no row", {"country": "x"}]


def hanging(html):
    if "hang" in html:
        time.sleep(600)
    return fine(html)


def dying(html):
    import os

    if "die" in html:
        os._exit(3)
    return fine(html)


def hungry(html):
    return [{"name": "x" * (1 << 31)}] if "eat" in html else fine(html)


def printing(html):
    print("this is no answer", flush=True)
    return fine(html)


def test_a_bad_parser_gives_no_rows_and_ends_nothing(spark):
    rows = [(1, "https://a.org/1", "x,y"), (1, "https://a.org/1", "x,y"), (2, "https://www.hang.org/", "p"), (3, "https://hang.org/", "hang"), (4, "https://hang.org/", "q"), (5, "https://die.org/", "die"), (6, "https://die.org/", "z"), (7, "https://eat.org", "eat"), (8, "https://eat.org", "m")]
    rows += [(9, "https://other.org", "x"), (10, None, "x"), (11, "https://a.org/", None), (12, "https://list.org", "x"), (13, "https://many.org", "x"), (14, "https://print.org", "w"), (None, "https://a.org/", "n")]
    own = {"a.org": fine, "hang.org": hanging, "die.org": dying, "eat.org": hungry, "list.org": lambda h: {"name": "x"}, "many.org": lambda h: [{"name": "x"}] * 10_001, "print.org": printing}
    began = time.monotonic()
    got = parsers.parsed(spark.createDataFrame(rows, PAGES), own, seconds=3).collect()
    assert time.monotonic() - began < 60
    named = sorted((r.page_id or 0, r.ord, r.name) for r in got if r.error is None)
    assert named == [(0, 0, "n"), (1, 0, "x"), (1, 0, "x"), (1, 1, "y"), (1, 1, "y"), (2, 0, "p"), (4, 0, "q"), (6, 0, "z"), (8, 0, "m"), (14, 0, "w")]
    said = {r.page_id: r.error for r in got if r.error}
    assert set(said) == {3, 5, 7, 11, 12, 13} and "too long" in said[3] and "ended" in said[5] and "MemoryError" in said[7] and "no name" in said[11] and "list" in said[12] and "10001" in said[13]
    told = {r["domain"]: tuple(r)[1:4] for r in parsers.outcomes(spark.createDataFrame(got, parsers.PARSED)).collect()}
    assert told["hang.org"] == (3, 1, 2) and told["a.org"][1] == 1
    assert parsers.parsed(spark.createDataFrame([], PAGES), own).count() == 0


def test_many_pages_of_a_domain_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(parsers, "PAGES", 10)
    rows = [(k, f"https://a.org/{k}", f"n{k}") for k in range(95)]
    got = parsers.parsed(spark.createDataFrame(rows, PAGES), {"a.org": fine})
    assert sorted(r.page_id for r in got.collect()) == list(range(95))


ROWS = "url string, session_id string, status string, n int, tags map<string,string>"


def test_a_second_write_replaces_the_first(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path), ["url"], buckets=4)
    assert t.rows() is None
    t.upsert(spark.createDataFrame([("a", "s", "running", 1, {"x": "y"}), ("b", "s", "running", 1, None), (None, "s", "lost", 1, None)], ROWS))
    t.upsert(spark.createDataFrame([("a", "s", "done", 2, None), ("a", "s", "old", 1, None), ("c", "s", "new", 1, None)], ROWS), order=F.col("n"))
    want = {"a": "done", "b": "running", "c": "new"}
    assert {r.url: r.status for r in t.rows().collect()} == want and t.rows().count() == 3
    bad = spark.createDataFrame([("a", "s", "half", 3, None), ("d", "s", "half", 3, None)], ROWS).withColumn("status", F.when(F.col("url") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="lost"):
        t.upsert(bad)
    assert {r.url: r.status for r in t.rows().collect()} == want  # the old rows are as they were
    stale = keyed.KeyedTable(spark, str(tmp_path), ["url"])
    held = stale.manifest()
    t.upsert(spark.createDataFrame([("e", "s", "new", 1, None)], ROWS))
    stale.manifest = lambda: held  # a writer that began before
    with pytest.raises(FileExistsError):
        stale.upsert(spark.createDataFrame([("f", "s", "new", 1, None)], ROWS))
    t.delete(spark.createDataFrame([("b",), ("zz",)], "url string"))
    before = {tuple(r)[:3] for r in t.rows().collect()}
    assert t.vacuum() > 0 and {tuple(r)[:3] for r in t.rows().collect()} == before and {r[0] for r in before} == {"a", "c", "e"}
    t.delete(spark.createDataFrame([("a",), ("c",), ("e",)], "url string"))
    assert t.rows().count() == 0


def test_progress_and_parsers_are_kept_once(spark, tmp_path):
    p = keyed.progress_table(spark, str(tmp_path / "p"))
    for at, status in (("2024-01-01", "running"), ("2024-01-02", "done")):
        keyed.save_progress(p, spark.createDataFrame([("u", "s1", at, status), ("u", "s2", at, "running")], "url string, session_id string, last_updated string, status string"))
    assert sorted((r.session_id, r.status) for r in p.rows().collect()) == [("s1", "done"), ("s2", "running")]
    library = keyed.ParserLibrary(spark, str(tmp_path / "l"))
    library.save(spark.createDataFrame([("a.org", "def parse"), ("b.org", "def parse")], "domain string, code string"))
    for _ in range(2):
        library.succeeded(spark.createDataFrame([("a.org", 3), ("a.org", 1), ("no.org", 5)], "domain string, n int"))
    library.invalidate(spark.createDataFrame([("b.org",)], "domain string"))
    got = library.rows().collect()
    assert [(r.domain, r.code, r.successes) for r in got] == [("a.org", "def parse", 8)] and got[0].last_used is not None
    library.save(spark.createDataFrame([("a.org", "def parse 2")], "domain string, code string"))
    assert [(r.code, r.successes) for r in library.rows().collect()] == [("def parse 2", 0)]


EDGES = "src string, dst string, kind string, score int"


def plain_crawl(seeds, edges, max_depth, per_host):
    """Rounds of a crawl in plain Python: what is found, and in which round."""
    clean = lambda u: re.sub("/+$", "", u.strip())
    host = lambda u: u.split("/")[2]
    seen = {clean(u): (0, 10, 0) for u in seeds}
    waiting, k = dict(seen), 0
    while waiting:
        k += 1
        by_host = {}
        for u, (d, p, _) in waiting.items():
            by_host.setdefault(host(u), []).append((-p, d, u))
        now = {u for x in by_host.values() for _, _, u in sorted(x)[:per_host]}
        best = {}
        for s, t, kind, score in edges:
            s, t = clean(s), clean(t)
            if s in now and t not in seen:
                d = seen[s][0] + (kind == "link")
                p = {"list": 9, "page": 8}.get(kind, min(max(score, 1), 10))
                if d <= max_depth:
                    best[t] = min(best.get(t, (0, 99)), (-p, d)) if t in best else (-p, d)
        new = {u: (d, -p, k) for u, (p, d) in best.items()}
        seen |= new
        waiting = {u: v for u, v in waiting.items() if u not in now} | new
    return {(u, *v) for u, v in seen.items()}


def test_fair_share_of_hosts(spark):
    url = lambda k: f"https://h{k % 3 if k % 4 else 0}.org/{k}" + "/" * (k % 2)
    edges = [(url(k), url((k * 7 + j * 13) % 200), ("link", "list", "page")[(k + j) % 3], (k * j) % 14 - 1) for k in range(200) for j in range(3)]
    seeds = [url(0), url(1), url(1) + "/"]
    for per_host, depth in ((2, 3), (1000, 2)):
        got = frontier.crawl_shared(spark.createDataFrame([(u,) for u in seeds], "url string"), spark.createDataFrame(edges, EDGES), depth, per_host=per_host, buckets=4)
        assert {tuple(r) for r in got.select("url", "depth", "priority", "round").collect()} == plain_crawl(seeds, edges, depth, per_host)
        assert got.count() == got.select("url").distinct().count()


def test_limit_without_batch_and_errors_end_a_crawl(spark):
    edges = spark.createDataFrame([(f"p{k}", f"p{2 * k + j}", "link", 1) for k in range(1, 32) for j in (0, 1)], EDGES)
    seeds = spark.createDataFrame([("p1",)], "url string")
    assert frontier.crawl(seeds, edges, 9, limit=2).count() == 5 and frontier.crawl(seeds, edges, 9, limit=1).count() == 3
    assert frontier.crawl_shared(seeds, edges, 9, limit=3, buckets=2).count() == 7
    failing = spark.createDataFrame([(f"p{k}",) for k in range(4, 16)], "url string")
    assert frontier.crawl(seeds, edges, 9, failing=failing).count() == 7
    assert frontier.crawl(seeds, edges, 9, failing=failing.filter("url <> 'p4'"), most_errors=2).count() == 9


def test_what_was_seen_is_not_shuffled(spark):
    visited = frontier.Visited(spark, buckets=8)
    schema = "url string, depth int, priority int, round int"
    for k in range(3):
        visited.add(visited.dealt(spark.range(k * 2000, k * 2000 + 2000).selectExpr("concat('u', id) as url", "0 as depth", "1 as priority", f"{k} as round")))
    found = spark.range(5000, 7000).selectExpr("concat('u', id) as url", "0 as depth", "1 as priority", "3 as round")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = visited.dealt(found).groupBy("url").agg(F.min("depth").alias("depth"))
        out = visited.unseen(best)
        assert out.count() == 1000
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        visited.close()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(url") + final.count("Exchange hashpartitioning(__url") == final.count("REPARTITION_BY_NUM")  # the links alone
    assert "Bucketed: true" in final and "SortMergeJoin" not in final
    assert visited.rows().count() == 6000 and visited.rows().schema == spark.createDataFrame([], schema).schema


def test_pieces_overlap_and_keep_the_text(spark):
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (1, 9, 10, 11, 17, 18, 40)] + ["", None, "  a \n b\t", "x" * 1000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row int, text string")
    got = {}
    for r in listings.pieces(rows, words=10, overlap=2).orderBy("row", "piece").collect():
        got.setdefault(r.row, []).append(r.text)
    for k, t in enumerate(texts):
        ws = re.findall(r"\S+\s*", t or "")
        want, at = [], 0
        while ws:
            want.append("".join(ws[at : at + 10]))
            if at + 10 >= len(ws):
                break
            at += 8
        assert got.get(k, []) == want
    with pytest.raises(ValueError):
        listings.pieces(rows, 5, 5)


def test_names_at_the_seams_count_once(spark):
    asked = []

    def model(texts):
        asked.extend(texts)
        return [None if "quiet" in t else f"Sure: {json.dumps({'is_vendor_listing': 'page' not in t, 'vendors': [{'Name': n, 'Booth No.': str(len(t)), 'empty': ' '} for n in re.findall('[A-Z]\\w+ Ltd', t)] + [{'country': 'x'}]})} done" for t in texts]

    words = [f"w{k}" for k in range(60)]
    for at, name in ((3, "Acme Ltd"), (18, "Seam Ltd"), (30, "Beta Ltd"), (31, "beta LTD"), (55, "Acme Ltd")):
        words[at] = name
    pages = [(1, "u", " ".join(words)), (1, "u", " ".join(words)), (2, "u", "quiet " * 30), (3, "u", "page Acme Ltd " * 20), (4, "u", None), (5, "u", "Short Ltd"), (None, "u", "Null Ltd " * 20)]
    df = spark.createDataFrame(pages, "page_id long, url string, text string")
    got = listings.listed(df, model, words=20, overlap=5, least=50)
    rows = sorted((r.page_id or 0, r.ord, r.name) for r in got.collect())
    assert [r[2] for r in rows if r[0] == 1] == ["Acme Ltd", "Seam Ltd", "Beta Ltd", "Acme Ltd"]
    assert {r[0] for r in rows} == {0, 1} and sum(r[0] == 0 for r in rows) == 1
    out = listings.vendors(got, {"event_name": "Expo", "country": "Japan"}).filter("page_id = 1 and ord < 5").first()
    assert out.event_name == "Expo" and out.country == "Japan" and set(out.extras) == {"booth_no"} and out.extraction_method == "listing_llm" and out.confidence_score > 0
    assert listings.listed(df, None).count() == 0
