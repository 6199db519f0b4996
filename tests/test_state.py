"""Caches, workers, listeners, learning blocklists, the search source and suffix rules."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from expodex import workers
from expodex.operators import domains, links
from expodex.sources import search, snapshot
from expodex.streaming import cache, feedback, progress

ASKS = "key string, entry string, at timestamp, ord long"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def simulated(rows, ttl, most, evict):
    """The cache row by row, with plain lists."""
    held, out = {}, []
    for key, entry, when, ord in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        live = [(e, t) for e, t in held.get(key, []) if (when - t).total_seconds() < ttl]
        known = [t for e, t in live if e == entry]
        if not known:
            live = (live[evict:] if len(live) > most else live) + [(entry, when)]
        held[key] = live
        out.append((key, ord, bool(known), known[0] if known else when))
    return sorted(out)


def utc(t):
    return None if t is None else t.astimezone(timezone.utc)


def answers(df):
    return sorted((r.key, r.ord, r.hit, utc(r.stored_at)) for r in df.collect())


def test_cache_of_a_table(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice("uvwxyz"), at(rng.randrange(4000)), k) for k in range(900)]
    for ttl, most, evict in ((600, 2, 1), (600, 3, 3), (60, 50, 5), (4000, 0, 1)):
        assert answers(cache.asked(spark.createDataFrame(rows, ASKS), ttl, most, evict)) == simulated(rows, ttl, most, evict)


def test_cache_of_odd_rows(spark):
    rows = [(None, "x", at(0), 1), (None, "x", at(0), 2), ("a", None, at(0), 3), ("a", "x", None, 4), ("a", "x", at(0), 5), ("a", "x", at(0), 5), ("a", "x", at(3600), 6)]
    got = cache.asked(spark.createDataFrame(rows, ASKS), 3600)
    assert sorted((r.ord, r.hit) for r in got.collect()) == [(1, False), (2, False), (3, False), (4, False), (5, False), (5, True), (6, False)]
    assert cache.asked(spark.createDataFrame([], ASKS)).count() == 0


def test_cache_of_a_stream_with_expiry_restart_and_late_rows(spark, tmp_path):
    cache.with_state_store(spark)
    path = str(tmp_path)

    def fed(*rows):
        spark.createDataFrame([("k", *r) for r in rows], ASKS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(ASKS).parquet(f"{path}/in")  # a new query every time: state comes from the checkpoint
        query = cache.asked_stream(stream, ttl=3600, most=2, evict=1, late="10 minutes").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress

    fed(("x", at(0), 1), ("x", at(10), 2), ("y", at(20), 3))
    fed(("x", at(1800), 4), ("z", at(1900), 5), ("x", at(1790), 6))  # row 6 is late, but within the watermark
    fed(("x", at(3601), 7), ("y", at(3500), 8))  # x has expired, y not
    fed(("w", at(3700), 9))  # three are held (y, z, x): the oldest goes
    fed(("y", at(3800), 10), ("z", at(3810), 11))
    last = fed(("v", at(20000), 12))
    last = fed(("v", at(20001), 13))  # by now the timers of all older entries have fired
    fed(("x", at(100), 14))  # beyond the watermark
    hits = {r.ord: r.hit for r in spark.read.parquet(f"{path}/out").collect()}
    assert hits == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: True, 9: False, 10: False, 11: False, 12: False, 13: True}
    assert last.stateOperators[0].numRowsTotal <= 6


def test_workers_go_on_after_a_kill(spark, tmp_path):
    path, rows = str(tmp_path / "run"), spark.range(1000).withColumnRenamed("id", "k")
    unit = F.col("k") % 10
    seen = []

    def work(part):
        seen.append(sorted(r.unit for r in part.select("unit").distinct().collect()))
        return part.groupBy("unit").agg(F.count("*").alias("n"), F.sum("k").alias("s"))

    def killed(part):
        work(part)
        if seen[-1][0] >= 4:
            raise KeyboardInterrupt
        return part.groupBy("unit").agg(F.count("*").alias("n"), F.sum("k").alias("s"))

    with pytest.raises(KeyboardInterrupt):
        workers.run(rows, killed, path, unit, wave=2)
    os.makedirs(tmp_path / "run/results/attempt=half/unit=4")  # what a stopped wave leaves
    spark.range(3).select(F.lit(9).alias("n"), F.lit(9).alias("s")).write.mode("overwrite").parquet(f"{path}/results/attempt=half/unit=4")
    assert {r.unit for r in workers.Ledger(spark, path).results().collect()} == {0, 1, 2, 3}
    del seen[:]
    ledger = workers.run(rows.limit(0), work, path, unit, wave=2)  # the rows are those of the first run
    assert seen == [[4, 5], [6, 7], [8, 9]]
    want = sorted((u, 100, sum(range(u, 1000, 10))) for u in range(10))
    assert sorted(tuple(r) for r in ledger.results().select("unit", "n", "s").collect()) == want
    assert ledger.summary().first()[:4] == (10, 0, 0, 10)
    assert ledger.vacuum() == 1 and ledger.results().count() == 10
    del seen[:]
    workers.run(rows, work, path, unit)
    assert seen == []


def test_a_bad_and_a_slow_unit_end_no_other(spark, tmp_path):
    path, rows = str(tmp_path), spark.range(60).withColumnRenamed("id", "k")

    def work(part):
        bad = F.when(F.col("unit") == 2, F.raise_error(F.lit("no such page"))).otherwise(F.col("k"))
        return part.withColumn("k", bad.cast("long"))

    ledger = workers.run(rows, work, path, F.when(F.col("k") % 6 < 5, F.col("k") % 6), wave=4)
    states = {r.unit: (r.status, r.rows) for r in ledger.states().collect()}
    assert states == {-1: ("done", 10), 0: ("done", 10), 1: ("done", 10), 2: ("error", 0), 3: ("done", 10), 4: ("done", 10)}
    again = workers.run(rows, lambda part: part, path, F.lit(0), attempts=2)
    assert {r.unit: (r.status, r.attempts) for r in again.states().collect()}[2] == ("done", 2)

    def slow(part):
        import time

        def wait(batches):
            time.sleep(60)
            yield from batches

        return part.mapInArrow(wait, part.schema)

    late = workers.run(rows, slow, str(tmp_path / "slow"), F.lit(0), seconds=2)
    assert late.states().first()["status"] == "timeout" and late.results() is None and late.summary().first()["timeout"] == 1


def test_listener_tells_batches_rows_and_errors(spark, tmp_path):
    path = str(tmp_path)
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    fails = stream.select(F.when(F.col("id") == 15, F.raise_error(F.lit("bad row"))).otherwise(F.col("id").cast("string")).alias("id"))
    with progress.watched(spark, f"{path}/progress"):
        stream.writeStream.format("parquet").option("path", f"{path}/a").option("checkpointLocation", f"{path}/ca").queryName("good").trigger(availableNow=True).start().awaitTermination()
        with pytest.raises(Exception, match="bad row"):
            fails.writeStream.format("parquet").option("path", f"{path}/b").option("checkpointLocation", f"{path}/cb").queryName("bad").trigger(availableNow=True).start().awaitTermination()
    rows = progress.progress_rows(spark, f"{path}/progress")
    told = {r["name"]: r for r in progress.progress_summary(rows).collect()}
    assert told["good"]["batches"] == 2 and told["good"]["input_rows"] == 20 and told["good"]["last_error"] is None
    assert "bad row" in told["bad"]["last_error"] and told["bad"]["runs"] == 1
    assert [r.batch for r in rows.filter("name = 'good' and event = 'batch' and input_rows > 0").orderBy("batch").collect()] == [0, 1]


def test_blocked_by_a_hundred_thousand_patterns(spark, tmp_path):
    rng = random.Random(2)
    letters = "abcdé%_.*-/"
    patterns = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 24))) for _ in range(100_000)] + ["", "Z/Q", "zz", "q"]
    urls = [(k, "https://x.org/" + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for k in range(1500)]
    urls += [(2000 + k, f"https://x.org/a/{rng.choice(patterns[:500])}/b") for k in range(300)] + [(3000, "https://x.org/pz/qr"), (3001, None), (3002, "https://zz.org/abc"), (3003, "https://x.org/AZZ"), (3003, "https://x.org/AZZ"), (3004, "https://x.org/1?q=1")]
    rows = spark.createDataFrame(urls, "k long, url string")
    con = duckdb.connect()
    con.execute("CREATE TABLE p AS SELECT DISTINCT lower(unnest(?::VARCHAR[])) AS p", [patterns])
    con.execute("CREATE TABLE u AS SELECT unnest(?::BIGINT[]) AS k, unnest(?::VARCHAR[]) AS url", [[k for k, _ in urls], [u for _, u in urls]])
    want = con.execute(r"SELECT k FROM u WHERE url IS NULL OR NOT EXISTS (SELECT 1 FROM p WHERE p <> '' AND contains(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), p)) ORDER BY k").fetchall()
    held = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    assert [tuple(r) for r in links.not_blocked(rows, held).select("k").orderBy("k").collect()] == want
    few = held.limit(300)
    assert links.without_patterns(rows, few).exceptAll(links.not_blocked(rows, few)).isEmpty() and links.not_blocked(rows, few).exceptAll(links.without_patterns(rows, few)).isEmpty()
    assert links.without_patterns(rows, held.limit(0)).count() == rows.count()


def test_feedback_shrinks_the_next_batch(spark, tmp_path):
    path = str(tmp_path)
    feedback.seeded(spark.createDataFrame([("Old-Junk",)], "pattern string"), f"{path}/patterns")

    def fed(*urls):
        spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("url string").parquet(f"{path}/in")
        feedback.learning(stream, F.col("url").contains("bad"), f"{path}/patterns", f"{path}/kept", f"{path}/c").awaitTermination()
        last = spark.read.schema("url string, batch int").parquet(f"{path}/kept")
        top = last.agg(F.max("batch")).first()[0]
        return sorted(r.url for r in last.filter(F.col("batch") == top).collect())

    assert fed("https://x.org/booking-now/bad", "https://x.org/booking-now/1", "https://x.org/ok", "https://x.org/old-junk/1", "https://x.org/plain/bad") == ["https://x.org/booking-now/1", "https://x.org/ok"]
    assert fed("https://x.org/en/Booking-Now/2", "https://x.org/plain/3") == ["https://x.org/plain/3"]
    assert sorted(r.pattern for r in feedback.patterns(spark, f"{path}/patterns").collect()) == ["booking-now", "old-junk"]
    assert sorted(r.pattern for r in feedback.patterns(spark, f"{path}/patterns", before=0).collect()) == ["old-junk"]


def saved(folder, name, *pages):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(p if isinstance(p, str) else json.dumps(p) for p in pages))


def page(query, region, *urls, **more):
    return {"query": query, "region": region, "results": [{"title": u, "url": u, "snippet": "s" * 400} for u in urls], **more}


def test_search_source_filters_and_offsets(spark, tmp_path):
    search.registered(spark)
    path = str(tmp_path)
    saved(f"{path}/engine=one", "a.json", page("q", "eu", "u1", "", "u2"), "{broken", "[]", page("q2", "us", "u3"), page("q", None, "u4"))
    saved(f"{path}/engine=two", "a.json", page("q", "eu", "u5"), page("q", "eu", "u6", engine="own"))
    read = spark.read.format("expodex_search").load(path)
    assert sorted((r.engine, r.url, r.ord) for r in read.collect()) == [("one", "u1", 0), ("one", "u2", 2), ("one", "u3", 0), ("one", "u4", 0), ("own", "u6", 0), ("two", "u5", 0)]
    some = read.filter("engine = 'one' and region in ('eu', 'xx') and length(snippet) = 300 and url > 'u'")
    assert sorted(r.url for r in some.collect()) == ["u1", "u2"]
    plan = some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and "engine" in line]
    assert pushed and "region" in pushed[0]
    reader = search.FilteringReader({"path": path})
    left = list(reader.pushFilters([search.EqualTo(("engine",), "one"), search.EqualTo(("url",), "u"), search.In(("engine",), ("one", None, "z"))]))
    assert len(left) == 1 and [p.path for p in reader.partitions()] == [f"{path}/engine=one/a.json"]

    def read_on():
        stream = spark.readStream.format("expodex_search").load(f"{path}/in")
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.url for r in spark.read.parquet(f"{path}/out").collect())

    saved(f"{path}/in", "1.json", page("q", "eu", "u1"))
    saved(f"{path}/in", "2.json", page("q", "eu", "u2"))
    assert read_on() == ["u1", "u2"]
    saved(f"{path}/in", "3.json", page("q", "eu", "u3"))
    assert read_on() == ["u1", "u2", "u3"]
    plain = snapshot.search_stream(spark, f"{path}/in", files_a_batch=2)
    plain.writeStream.format("parquet").option("path", f"{path}/p").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(f"{path}/p").collect()) == ["u1", "u2", "u3"]


def test_search_table_prunes_and_pushes(spark, tmp_path):
    hits = spark.createDataFrame([("q", "one", "eu", 0, "t", "u", ""), ("q", "two", "eu", 0, "t", "v", "")], search.SCHEMA)
    snapshot.write_search(hits, str(tmp_path / "t"))
    some = snapshot.search_table(spark, str(tmp_path / "t")).filter("engine = 'two' and region = 'eu'")
    plan = some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert [r.url for r in some.collect()] == ["v"] and "PartitionFilters: [isnotnull(engine" in plan and "EqualTo(region,eu)" in plan


def test_suffix_rules_from_a_file(spark, tmp_path):
    saved(str(tmp_path), "rules.dat", "// comment", "", "com", "CO.UK  and more", "*.ck", "!www.ck", "com")
    rules = domains.suffix_rules(spark, str(tmp_path / "rules.dat"))
    assert sorted(r.rule for r in rules.collect()) == ["!www.ck", "*.ck", "co.uk", "com", "com"]
    hosts = spark.createDataFrame([("a.b.co.uk",), ("a.b.co.uk",), ("x.www.ck",), (None,), ("...",), ("[::1]:80",), ("1.2.3.4:5",)], "host string")
    got = {r.host: (r.suffix, r.registered) for r in domains.registered_domains(hosts, rules).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "b.co.uk"), "x.www.ck": ("ck", "www.ck"), "...": (None, None), "[::1]:80": (None, "[::1]"), "1.2.3.4:5": (None, "1.2.3.4")}
    assert domains.registered_domains(hosts.limit(0), domains.default_rules(spark)).count() == 0
