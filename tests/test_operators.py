import random

import pytest
from pyspark.sql import functions as F

from expodex import catalog, plans, sinks, streaming
from expodex.operators import dom, extract, frontier, hooks, links, records
from expodex.sources import snapshot


def pages(spark, *rows):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_dom_tolerates_what_pages_hold():
    page = dom.Page('<div class="company x"><h1>A &amp; B</h1><p>one<p>two<br>three</div><ul><li>a<li>b</ul><script>no</script></p></i>')
    assert "|".join(page.texts) == "A & B|one|two|three|a|b"
    assert page.text(page.first(".company h1")) == "A & B" and page.text(0, "|") == "A & B|one|two|three"
    assert page.tags[page.first("[class*='comp']")] == "div" and page.first("h2.company") is None
    assert page.children(0) == [1, 2, 3] and page.inside(0, "p") == [2, 3] and page.raw == {8: "no"}
    with pytest.raises(ValueError):
        page.first("a > b")


def test_dom_is_linear_on_hostile_pages():
    for source in ("<div" * 200_000, "<div>" * 100_000, "<p '>' " * 60_000 + '"', "<a b=\"x>" * 100_001, "<!--" * 100_000, "<script>" * 50_000, "</p>" * 100_000, "<li>" * 100_000, "<" * 200_000 + ">"):
        dom.Page(source)


def test_schema_org_overlay_graph_and_open_graph(spark):
    html = """<html><script type="application/ld+json">{"@graph":[{"@type":"WebSite","name":"Site"},{"@type":"Organization","name":"Acme","url":["https://acme.com"],"telephone":"1",
    "address":{"addressLocality":"Bonn","addressCountry":{"name":"Germany"}}}]}</script><script type="application/ld+json">not json</script>
    <meta property="og:type" content="website"><meta property="og:description" content="Makers of anvils"></html>"""
    micro = '<div itemscope itemtype="x"><span itemprop="name">Micro</span><a itemprop="url" href="https://m.io">x</a></div>'
    got = extract.schema_org_records(pages(spark, ("https://e.org", html), ("https://e.org", micro), ("https://e.org", "<p>none"))).orderBy("page_id").collect()
    assert [(r.name, r.website, r.city, r.country, r.description) for r in got] == [("Acme", "https://acme.com", "Bonn", "Germany", "Makers of anvils"), ("Micro", "https://m.io", None, None, None)]


def test_rule_based_record(spark):
    html = """<html><title>Acme | Expo</title><div class="exhibitor"><h2>Acme GmbH</h2></div><a href="mailto:Info@acme.de?x=1">mail</a><a class="website" href="/go">Web</a>
    <a href="https://www.linkedin.com/company/acme">in</a><a href="https://www.acme.de">Official website</a><div class="address">1 Road, Bonn, Germany</div>
    <div class="info-row"><b>Stand No.</b><i>4B-12</i></div><p>Phone: +49 228 123456</p></html>"""
    r = extract.rule_based_records(pages(spark, ("https://expo.org/1", html))).first()
    assert (r.name, r.email, r.website, r.linkedin, r.city, r.country, r.phone, r.booth_number) == (
        "Acme GmbH", "Info@acme.de", "https://expo.org/go", "https://www.linkedin.com/company/acme", "Bonn", "Germany", "+49 228 123456", "4B-12"
    )


def test_metadata_scores_and_rendering(spark):
    html = '<html><title>Big Expo 2026</title><div class="venue">Hall 5, Paris</div><meta name="event.date" content="1-3 May 2026"><span itemprop="organizer">Org</span>' + '<div class="vendor-card">vendor booth</div>' * 12 + '<ul class="pager"></ul></html>'
    r = extract.page_metadata(pages(spark, ("https://e.org", html))).first()
    assert (r.event_name, r.event_location, r.event_date, r.organizer) == ("Big Expo 2026", "Hall 5, Paris", "1-3 May 2026", "Org")
    r = extract.page_event_scores(pages(spark, ("https://e.org/directory", html))).first()
    assert (r.score, r.is_event_page) == (15 + 15 + 20 + 10 + 5, True) and "has_pagination" in r.evidence
    assert pages(spark, ("u", '<div id="root"></div>')).select(extract.needs_render(F.col("html"))).first()[0]


def test_empty_inputs(spark):
    none = pages(spark).limit(0)
    for f in (links.links, links.vendor_urls, links.next_links, links.pagination, extract.page_metadata, extract.schema_org_records, extract.rule_based_records, plans.extraction):
        assert f(none).count() == 0
    odd = pages(spark, (None, None), ("", ""), ("not a url", "<a href=>x</a><a href='mailto:x'>y</a>"))
    for f in (links.links, links.vendor_urls, links.next_links, links.pagination, extract.schema_org_records):
        assert f(odd).count() == 0


def test_seed_dedup_equals_the_loop(spark):
    rng = random.Random(5)
    rows = [(k, f"https://{rng.choice('abcde')}.com/{rng.randrange(6)}{rng.choice(['', '/'])}", rng.randrange(9)) for k in range(400)]
    seen, domains, want = set(), set(), []
    for k, url, score in rows:
        key, domain = url.rstrip("/").lower(), url.split("/")[2]
        if key in seen:
            continue
        seen.add(key)
        if domain in domains and score < 5:
            continue
        domains.add(domain)
        want.append(k)
    got = records.deduplicated_seeds(spark.createDataFrame(rows, "ord long, url string, score int"))
    assert sorted(r.ord for r in got.collect()) == want


def test_dedup_keeps_one_row_a_key_and_every_value(spark):
    rows = catalog.fixture(spark, "vendors_f").withColumn("confidence_score", F.col("confidence_score").cast("double"))
    got = {r.dedup_key: r for r in records.deduplicated(rows).collect()}
    assert len(got) == rows.transform(records.dedup_key).select("dedup_key").distinct().count()
    r = got["acme.com|expo 1"]
    assert (r.ord, r.email, r.phone, r.category, r.merged) == (2, "a@acme.com", "+1 555 0100", "tools", 2)


def test_crawl_waits_its_turn_and_never_returns(spark):
    edges = catalog.fixture(spark, "edges_f")
    seeds = spark.createDataFrame([("a",)], "url string")
    got = {r.url: (r.depth, r.round) for r in frontier.crawl(seeds, edges, max_depth=4, batch=1).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", "f", "g"} and got["a"] == (0, 0) and got["d"] == (0, 2)
    assert {r.url for r in frontier.crawl(seeds, edges, max_depth=0).collect()} == {"a", "c", "d"}


def test_sinks_round_trip(spark, tmp_path):
    df = catalog.fixture(spark, "vendors_f").withColumn("extras", F.create_map(F.lit("company_size"), F.when(F.col("ord") < 4, "10").otherwise("")))
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == df.count() and back.columns[0] == "Company Name" and back.columns[-1] == "Company Size"
    sinks.write_csv_file(df, str(tmp_path / "one.csv"))
    raw = (tmp_path / "one.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\n") == df.count() + 1
    sinks.write_json(df, str(tmp_path / "json"))
    rows = [r.value for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(rows) == df.count() and all('"name":' in r and '"source_url":' in r and '"phone":""' not in r for r in rows)
    sinks.write_report(df, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/statistics")).filter("metric = 'total'").first().value == "10"
    registry = sinks.Registry(spark, str(tmp_path / "registry"))
    registry.register(df.drop("extras"))
    registry.register(df.drop("extras", "email"))
    assert registry.count() == 16
    assert registry.replaced(registry.rows().limit(3), str(tmp_path / "registry2")).count() == 3
    cache = sinks.ParserCache(spark, str(tmp_path / "parsers"))
    cache.save("a.org", 2)
    cache.save("a.org", 1)
    assert cache.listed().first().success_count == 3
    progress = catalog.fixture(spark, "progress_f").withColumn("session_id", F.lit("s"))
    sinks.write_progress(progress, str(tmp_path / "progress"))
    assert snapshot.progress(spark, str(tmp_path / "progress")).count() == 4


def test_feedback_and_names(spark):
    rejected = spark.createDataFrame([("https://a.org/Booking-now/x",), ("https://a.org/booking-now",), ("https://a.org/news",), ("https://a.org/tic",)], "url string")
    known = spark.createDataFrame([], "pattern string")
    assert [r.pattern for r in sinks.blocklist_feedback(rejected, known).collect()] == ["booking-now"]
    assert sinks.file_name("My: Expo!").startswith("vendors_My_Expo_") and sinks.progress_name("u").endswith(".json")


def test_search_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"query":"q","engine":"g","region":"r","organic":[{"title":"t","url":"https://a","snippet":"s"},{"title":"no url"}]}\n{"query":"q2","results":[{"url":"https://b"}]}\n')
    assert [(r.query, r.ord, r.url) for r in snapshot.search_results(spark, str(tmp_path / "a.json")).collect()] == [("q", 0, "https://a"), ("q2", 0, "https://b")]
    spark.dataSource.register(snapshot.SearchSource)
    got = spark.read.format("expodex_search").option("paths", str(tmp_path / "a.json")).load()
    assert sorted(r.url for r in got.collect()) == ["https://a", "https://b"]
    (tmp_path / "b.json").write_text('{"blocked_path_patterns": ["book", "", "x"]}')
    assert snapshot.blocklist(spark, str(tmp_path / "b.json")).count() == 2


def test_streams_agree_with_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(2).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    keyed = streaming.new_vendors(stream.withColumn("dedup_key", F.col("user_id")), late="3650 days")
    got = []
    q = streaming.append_each(keyed, lambda df, k: got.extend(r.user_id for r in df.collect()), str(tmp_path / "check"))
    q.awaitTermination()
    assert sorted(got) == sorted(r.user_id for r in events.select("user_id").distinct().collect())


def test_crawl_follows_long_chains_and_says_when_it_stops(spark):
    seeds = spark.createDataFrame([("p0",)], "url string")
    edges = spark.createDataFrame([(f"p{k}", f"p{k + 1}", "page", 0) for k in range(24)], "src string, dst string, kind string, score int")
    assert {r.url for r in frontier.crawl(seeds, edges).collect()} == {f"p{k}" for k in range(25)}
    with pytest.raises(RuntimeError):
        frontier.crawl(seeds, edges, max_rounds=3)


def test_repeated_and_null_ids_give_a_record_each(spark):
    html = "<h1>Acme</h1><p>info@acme.org</p>"
    rows = spark.createDataFrame([(1, "https://e.org/1", html), (1, "https://e.org/1", html), (None, "https://e.org/2", html)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.name, r.email) for r in extract.rule_based_records(rows).collect()) == [(0, "Acme", "info@acme.org"), (1, "Acme", "info@acme.org"), (1, "Acme", "info@acme.org")]
    assert plans.extraction(rows).count() == 3


def test_extraction_reads_a_page_once_and_takes_documents(spark):
    rows = pages(spark, ("https://e.org/1", "<h1>Acme</h1>"))
    docs = spark.createDataFrame([("https://e.org/list.pdf", "| NO. | COMPANY NAME | COUNTRY |\n|---|---|---|\n| 1 | Beta Ltd | Japan |\n| 2 | Gamma Ltd | USA |\n| 3 | Delta Ltd | |"), ("https://e.org/page", "1 Not Listed  Japan")], "url string, markdown string")
    out = plans.extraction(rows, documents=docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted((r.name, r.country) for r in out.collect()) == [("Acme", None), ("Beta Ltd", "Japan"), ("Delta Ltd", None), ("Gamma Ltd", "United States")]


def test_links_of_a_page_need_no_shuffle(spark):
    plan = links.best_links(pages(spark, ("https://e.org", "<a href='/exhibitors'>x</a>")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_hooks_do_nothing_by_default(spark):
    rows = spark.createDataFrame([(1, "a"), (None, None)], "id long, text string")
    assert hooks.answers(rows, None).count() == 0
    assert [r.answer for r in hooks.answers(rows, lambda texts: [t.upper() for t in texts]).collect()] == ["A"]
    said = []

    def once(error):
        said.append(error)
        if len(said) < 3:
            raise ValueError(f"no {len(said)}")
        return "done"

    assert hooks.retried(once, sleep=lambda s: None) == "done" and said == [None, "no 1", "no 2"]
    with pytest.raises(ValueError):
        hooks.retried(lambda e: int("x"), attempts=2, sleep=lambda s: None)
    assert hooks.must_stop(True, 0, 0) and hooks.must_stop(False, 5000, 0) and hooks.must_stop(False, 0, 31) and not hooks.must_stop(False, 4999, 30)
    assert hooks.supervised({"errors": 12}, lambda s: "stop") == "stop" and hooks.supervised({"errors": 6, "phase": "crawl"}) == "continue"
    assert hooks.needs_supervisor(6, "crawl") and not hooks.needs_supervisor(6, "extract")


def test_discovery_follows_the_regions_of_a_query(spark):
    from expodex import dictionaries as D

    hits = [("drone expo tokyo exhibitors list", "yahoo", "Japan", k, f"t{k}", f"https://h{k}.jp/expo", "") for k in range(60)]
    hits += [("drone expo tokyo exhibitors list", "naver", "Korea", 0, "t", "https://k.kr/expo", ""), ("other query", "yahoo", "Japan", 0, "t", "https://o.jp", "")]
    results = spark.createDataFrame(hits, "query string, engine string, region string, ord int, title string, url string, snippet string")
    got = plans.discovered("drone expo tokyo", results, D.region_table(spark)).collect()
    assert len(got) == 60 and all(r.url.endswith(".jp/expo") for r in got)  # two regions asked: up to 100
    assert len(plans.seeds(results).collect()) == 40
    assert snapshot.fallback_results(results, "drone expo tokyo").count() == 15


def test_state_can_be_cleared(spark, tmp_path):
    cache = sinks.ParserCache(spark, str(tmp_path / "parsers"))
    cache.save("a.org", 2)
    cache.invalidate("a.org")
    cache.save("b.org", 1)
    assert [r.domain for r in cache.listed().collect()] == ["b.org"]
    progress = catalog.fixture(spark, "progress_f").withColumn("session_id", F.lit("s"))
    sinks.write_progress(progress, str(tmp_path / "progress"))
    assert sinks.cleared_sessions(spark, str(tmp_path / "progress"), "s") and not sinks.cleared_sessions(spark, str(tmp_path / "progress"), "t")
    registry = sinks.Registry(spark, str(tmp_path / "registry"))
    registry.register(catalog.fixture(spark, "vendors_f"))
    registry.clear()
    assert registry.count() == 0
    with pytest.raises(ZeroDivisionError):
        sinks.partial_exports(catalog.fixture(spark, "vendors_f"), str(tmp_path), lambda df: 1 / 0)
    assert spark.read.text(str(tmp_path / "partial")).count() == 10
    from expodex.operators import report

    df, counters = report.observed(catalog.fixture(spark, "progress_f"))
    assert df.count() == 4 and counters.get == {"rows": 4, "errors": 1}
    (tmp_path / "r.json").write_text('{"url":"u","markdown":"short"}\n{"url":"u","markdown":"longer text"}\n{"url":"v","markdown":" "}\n')
    assert [(r.url, r.markdown) for r in snapshot.markdown(spark, str(tmp_path / "r.json")).collect()] == [("u", "longer text")]


def test_blocked_patterns_are_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([("https://e.org/Book.x/1",), ("https://e.org/ok",), (None,)], "url string")
    patterns = spark.createDataFrame([("book.x",), ("",), ("zz",)], "pattern string")
    assert sorted(r.url or "" for r in links.blocked(rows, patterns).collect()) == ["", "https://e.org/ok"]
    monkeypatch.setattr(links, "MOST_PATTERNS", 1)
    with pytest.raises(ValueError):
        links.blocked(rows, patterns)
