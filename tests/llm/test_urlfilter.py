from expodex.llm import urlfilter


def test_rules_terms_and_odd_rows(spark):
    rows = {
        1: ("https://www.Example.ORG/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
        2: ("https://example.org/en/12?x=/es/", "example.org", "/en/12", "example.org/en/1", "block"),
        3: ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        4: ("http://casino.example.org/x", "casino.example.org", "/x", "org/", "allow"),
        5: ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        6: ("http://a.com/de/casino", "a.com", "/de/casino", "com/de/", "block"),
        7: ("http://a.com/en/casino-win", "a.com", "/en/casino-win", None, "block"),
        8: ("http://a.net/casinos/winner", "a.net", "/casinos/winner", None, "allow"),
        9: ("http://cheap-pills.net#x", "cheap-pills.net", "", None, "block"),
        10: ("http://cheap-cheap.net", "cheap-cheap.net", "", None, "allow"),
        11: ("casino", "", "", None, "block"),
        12: (None, "", "", None, "allow"),
        13: ("", "", "", None, "allow"),
        14: ("http://org", "org", "", None, "allow"),
        15: ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        16: ("x://" + "a" * 50000 + ".com/fr/" + "b" * 50000, "a" * 50000 + ".com", "/fr/" + "b" * 50000, "com/fr/", "allow"),
    }
    df = spark.createDataFrame([(k, v[0], "h", "p") for k, v in rows.items()] * 2, "page_id long, url string, host string, verdict string")
    got = urlfilter.judged(df).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == rows[r.page_id][1:], r.page_id
    assert urlfilter.judged(df.limit(0)).count() == 0


def test_weights_are_parameters(spark):
    df = spark.createDataFrame([(1, "http://a.net/foo"), (2, "http://a.net/bar")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judged(df, vocabulary={"strict": ["foo"], "soft": ["bar"], "soft_limit": 1}).collect()}
    assert got == {1: "block", 2: "block"}
