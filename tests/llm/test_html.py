import re

from expodex.llm import html
from expodex.llm.common import table

ARTICLE = "<h1>Title &amp; more</h1><p>One<br>two &nbsp; <a href=x>three</a></p>tail <b>text<ul><li>a<li>b</ul>"
NOISE = (
    '<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="home"><header><h1>Site</h1></header>'
    '<nav><ul><li><a href="/">Menu</a></ul></nav><div class="cookie-notice">Accept</div><div id="wrap"><div class="content post-%d">' + ARTICLE
    + '<div class="share">Share</div></div><aside><p>' + "x " * 900 + '</p></aside><section id="comments"><p>' + "y " * 900 + "</p></section></div>"
    '<form><p>Search</p></form><!-- <p>gone</p> --><footer>&copy;</footer></body></html>'
)
WANT = "Title & more\n\nOne two three\n\ntail text\n\na\n\nb"


def test_noise_is_left_out_and_hosts_agree(spark):
    rows = [(k, f"http://h.org/{k}", NOISE % k, "x", 1) for k in range(9)]
    teaser = NOISE % 9
    teaser = teaser.replace("</body>", "<div class='teasers'><p>" + "teaser text " * 60 + "</p></div></body>")
    rows.append((9, "http://H.org/9", teaser, "x", 1))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r for r in html.extracted(df).collect()}
    assert len(got) == 10 and all(r.text == WANT and r.n_chars == len(WANT) for r in got.values())
    assert html.Page(teaser).extract(None) != WANT  # the host's path is what finds it


def test_whole_table(spark, data):
    pages = table(spark, data, "pages")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html.extracted(pages).collect():
        body = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", body)
        import html as entities

        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a.b/", ""), (3, "x", "plain &lt;text&gt;"), (4, "http://a.b/", "<p>a<p>b <b>c"), (5, "http://a.b/", "<div" * 500), (6, "http://c.d/", "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "http://c.d/", "<p>" + "long " * 60000), (7, "http://c.d/", "<p>" + "long " * 60000), (None, "http://a.b/", "<p>a<p>b <b>c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.extracted(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3] == "plain <text>" and by[4] == by[None] == "a\n\nb c" and by[6] == "deep" and len(by[7]) == 5 * 60000 - 1
    assert html.extracted(df.limit(0)).count() == 0


def test_title_beside_the_text():
    page = "<body><main><h1>Title</h1><div class='by'>Ann</div><div class='text'>" + "<p>words and words</p>" * 9 + "</div></main><div class='cookiebar'><p>" + "z " * 500 + "</p></div></body>"
    assert html.Page(page).extract(None) == "\n\n".join(["Title", "Ann", *["words and words"] * 9])


def test_left_out_inlines_nest_and_end():
    page = "<article><p>" + "good words " * 9 + '<span class="ad">x <span>y</span> LEAK</span> after <b>bold</b></p><p><span class="ad">z<p>last</article>'
    assert html.Page(page).extract(None) == " ".join(["good words"] * 9) + " after bold\n\nlast"


def test_classes_are_judged_as_wholes():
    kept = ["promotion-history", "social-science", "menu-engineering", "navigation-in-birds", "related-work"]
    gone = ["promo", "ad-slot", "share-buttons", "cookie-bar", "related-posts", "post-navigation", "comments-area", "newsletter_box", "widget"]
    page = "<article><p>start of the text</p>" + "".join(f'<div class="{c}"><p>K {c}</p></div>' for c in kept) + "".join(f'<div class="{c}"><p>G {c}</p></div>' for c in gone) + "</article>"
    assert html.Page(page).extract(None) == "\n\n".join(["start of the text", *(f"K {c}" for c in kept)])


def test_several_articles_of_one_page_stay_together():
    page = "<body><main>" + "".join(f"<article><h1>T{k}</h1><p>{'words of it ' * 20}</p></article>" for k in range(3)) + "</main></body>"
    assert [f"T{k}" in html.Page(page).extract(None) for k in range(3)] == [True] * 3


def test_unbalanced_quotes_lose_one_tag_at_most():
    page = '<body><div class="menu>x</div><article><h1>T</h1><p title=\'it>one two three</p></article></body>'
    assert "one two three" in html.Page(page).extract(None)


def test_hostile_pages_take_seconds():
    import time

    began = time.perf_counter()
    for page in ("<div" * 250_000, '<div class="container">' * 100_000 + "deep", "<p '>" * 100_000 + '"', "<li></li>" * 100_000, "<" * 500_000 + ">", "<b class=ad>" * 100_000, "<h1>x" * 50_000, "<span class=ad><i>" * 50_000, "<!--" * 200_000, "<textarea>" * 100_000):
        html.Page(page).extract(None)
    assert time.perf_counter() - began < 60


def test_ties_of_paths_and_repeated_rows(spark):
    a, b = "<body><main><p>alpha words here</p></main></body>", "<body><section><p>alpha words here</p></section></body>"
    rows = [(1, "http://h.org/1", a), (2, "http://h.org/2", b), (2, "http://h.org/2", b), (1, "http://h.org/1", a)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.path for r in html.host_paths(df).collect()] == ["/body/main"]
    assert [r.text for r in html.extracted(df).collect()] == ["alpha words here"] * 4


TEXT = "".join(f"<p>Sentence number {k} of the article, which runs on for a while.</p>" for k in range(12))
SAID = "\n\n".join(f"Sentence number {k} of the article, which runs on for a while." for k in range(12))
AROUND = {
    "layout with the article in it": '<div class="sidebar-right"><div class="entry">{}</div></div>',
    "layout around main": '<div class="sidebar-layout"><main><article>{}</article></main></div>',
    "a word that begins like another": '<div class="commentary">{}</div>',
    "content for subscribers": '<div class="subscriber-content">{}</div>',
    "content beside a weak word": '<div class="content widget">{}</div>',
    "a form around the page": '<form id="aspnetForm"><input type="hidden"><div id="page"><div class="body">{}</div></div></form>',
    "regions in regions": '<form><div class="sidebar-left"><div class="widget"><section>{}</section></div></div></form>',
    "a weak word around main with a long rest": '<p>Some words that stand outside.</p><div class="rail"><main>{}</main></div><div><p>' + "other words " * 30 + "</p></div>",
}


def test_signs_of_layout_lose_no_article():
    for what, around in AROUND.items():
        for noise in ("", '<nav>Menu</nav><div class="cookie-bar">Accept all of it</div><section id="comments"><p>' + "a comment " * 90 + '</p></section><div class="sidebar"><p>Short notes</p></div>'):
            page = f"<html><body>{around.format(TEXT)}{noise}</body></html>"
            assert SAID in html.Page(page).extract(None), what
            assert not any(x in html.Page(page).extract(None) for x in ("Accept", "comment", "Menu", "Short notes")), what


def test_weak_signs_still_leave_out():
    page = "<body><div class='text'>" + TEXT + "</div>" + "".join(f"<{t}><p>{'left out words ' * 30}</p></{t.split()[0]}>" for t in ("div class='sidebar'", "div class='widget'", "form", "div class='related-posts'", "div class='subscribe'")) + "</body>"
    assert html.Page(page).extract(None) == SAID
    teasers = "".join(f"<article><p>{'teaser ' * 30}</p></article>" for _ in range(3))
    assert html.Page("<body><article>" + TEXT + f"</article><div class='related'>{teasers}</div></body>").extract(None) == SAID


def test_nesting_survives_blocks_in_inlines():
    page = '<article><p>before</p><span class="ad">a <span>b <div>c</div> d</span> LEAK</span><p>' + "after " * 40 + "</p></article>"
    assert html.Page(page).extract(None) == "before\n\n" + " ".join(["after"] * 40)


def test_hosts_disagree_and_each_decides_for_its_pages(spark):
    """Three hosts of different paths; on each, pages with a longer box of another path follow their host."""
    shapes = {"a.org": '<main class="m{}">{}</main>', "b.org": '<div class="wrap"><div class="story n{}">{}</div></div>', "c.org": '<table><tr><td><section id="x{}">{}</section></td></tr></table>'}
    rows, k = [], 0
    for host, shape in shapes.items():
        for n in range(7):
            box = f"<div class='box'><p>{'a longer box of words ' * 60}</p></div>" if n > 4 else ""
            rows.append((k, f"https://{host}/{n}", f"<body>{box}{shape.format(n, TEXT)}</body>"))
            k += 1
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len({r.host_path for r in got}) == 3 and all(r.text == SAID for r in got)
    assert sum(html.Page(r[2]).extract(None) != SAID for r in rows) == 6
