from expodex.llm import langid
from expodex.llm.common import table


def test_held_out_accuracy(spark, data):
    docs = table(spark, data, "documents")
    rows = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and held
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_many_languages(spark):
    # more than one mask word: 70 languages of own syllables
    rows = [(k * 50 + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)}qu{chr(97 + k % 26)} zi{chr(97 + k // 26)}{chr(97 + k % 26)}o " * 5, f"l{k:02}") for k in range(70) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predictions(docs).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.95 * len(rows)


def test_odd_rows(spark, odd, none):
    got = {r.doc_id: r for r in langid.predictions(odd).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 10)] == ["und"] * 4 and got[1].score == 0
    assert got[7].lang_pred in ("en", "es") and got[None].held_out is None
    assert langid.predictions(none).count() == 0
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and not {1, 2, 3, 10} & {r.doc_id for r in kept.collect()}
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.predictions(unlabelled).collect()} == {"und"}


def test_false_positives_are_corrected():
    import numpy as np

    rng = np.random.default_rng(2)
    own = {k: rng.integers(0, 2**40, 900_000, dtype=np.uint64) for k in ("a", "b")}
    filters = langid.Filters(own)
    code = np.concatenate([own["a"][:5000], rng.integers(0, 2**40, 5000, dtype=np.uint64)])
    total, counts = filters.counts(np.zeros(len(code), np.int64), code, 1)
    assert filters.wrong.min() > 0.05  # crowded on purpose
    assert total[0] == 10000 and abs(counts[0, 0] - 5000) < 300 and counts[0, 1] < 300


def test_counts_equal_exact_sets():
    """Filters against plain sets of n-grams: found counts of every text, and what is learned of every language."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    word = lambda lang: "".join(rng.choice(list(letters[lang]), 5))
    train = {lang: [" ".join(word(lang) for _ in range(200)) for _ in range(5)] for lang in letters}

    def exact(text):
        out = []
        padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        for n in langid.LENGTHS:
            for k in range(len(padded) - n + 1):
                g = padded[k : k + n]
                if " " not in g[1:-1] and g.strip():
                    out.append(g)
        return out

    sets = {lang: {g for t in texts for g in exact(t)} for lang, texts in train.items()}

    def codes(texts):
        from expodex.llm.common import flat_bytes

        return np.unique(langid.grams(*flat_bytes(pa.array(texts)))[1])

    filters = langid.Filters({lang: codes(texts) for lang, texts in train.items()})
    assert {lang: len(codes(texts)) for lang, texts in train.items()} == {lang: len(s) for lang, s in sets.items()}
    tests = [" ".join(word(lang) for _ in range(30)) for lang in letters for _ in range(5)]
    from expodex.llm.common import flat_bytes

    total, counts = filters.counts(*langid.grams(*flat_bytes(pa.array(tests))), len(tests))
    for k, text in enumerate(tests):
        own = exact(text)
        assert total[k] == len(own)
        for j, lang in enumerate(filters.languages):
            assert abs(counts[k, j] - sum(g in sets[lang] for g in own)) < 0.5 + 0.001 * len(own)
    names, _, _ = filters.judge(pa.array([*tests, "", "123", None]))
    assert names[-3:] == ["und"] * 3
    both = langid.Filters({"bb": codes(train["aa"]), "aa": codes(train["aa"])})
    assert both.judge(pa.array(tests[:1]))[0] == ["aa"]  # a tie goes to the alphabetically first
