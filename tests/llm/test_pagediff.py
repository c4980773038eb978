import random

import pytest
from pyspark.sql import functions as F

from askframe.llm import pagediff


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = max(
                best[i][j + 1], best[i + 1][j], best[i][j] + (a[i] == b[j]))
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_longest(seed):
    draw = random.Random(seed)
    a, b = ([draw.randrange(6) for _ in range(draw.randrange(25))] for _ in range(2))
    places = pagediff.common(a, b)
    assert places == sorted(set(places)) and len(places) == lcs(a, b)
    rest = iter(b)
    assert all(any(x == a[i] for x in rest) for i in places)


ARTICLE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>hidden --><div class="ad">Buy
</div><div id="cookie-notice"><p>We use cookies</p></div><header><h1>Site</h1></header>
<article><header><h1>A &amp; B</h1><p>by somebody</p></header><p><b>One &lt;two&gt;
 three<br>four<p>Five&nbsp;six &#233;</p><aside>See also</aside><ul><li>x</li><li>y</li></ul>
<form><label>mail</label><input></form><div class="comments"><article class="comment"><p>First!</p></article></div>
<p>last</p></article><div class="sidebar"><p>more</p></div><footer>&copy; us"""


def test_marked_articles():
    lines, evidence = pagediff.lines_of(ARTICLE)
    assert lines == ["A & B", "One <two> three four", "Five six é", "x", "y", "last"]
    assert set(evidence) == {pagediff.MARKED}


@pytest.mark.parametrize("page, lines", [
    (None, []), ("", []), ("plain text\n only", ["plain text only"]), ("<p>a<p>b", ["a", "b"]),
    ("<div class=content><p>in</p></div><p>out</p>", ["in"]), ("a < b <", ["a < b <"]),
    ("<script>never ends <p>x", []), ("<!-- open <p>x", []), ("<p title='a > b'>x</p>", ["x"]),
    ("<main><p>x</p></main><section class='comments'><article>y</article></section>", ["x"]),
])
def test_other_pages(page, lines):
    assert pagediff.lines_of(page)[0] == lines


def site(path, *own, host="h.example"):
    shared = "<div>Welcome to the site</div><div>All about it</div>"
    body = "".join(f"<div>{x}</div>" for x in own)
    return f"http://{host}{path}", f"<html><body>{shared}{body}<div>Call us</div></body></html>"


def test_lines_shared_with_the_nearest_url_go(spark):
    pages = [site("/a/1", "one", "only here"), site("/a/2", "two"), site("/b/1", "three", "one"),
             site("/z", "alone", host="other.example"), (None, "<p>no url</p>"), ("x", None),
             ("http://h.example/art", "<article><p>All about it</p></article>")]
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    df = df.withColumn("key", F.lit(0)).withColumn("gone", F.lit(1)).withColumn("host", F.lit("x"))
    got = {r.page_id: r.text for r in pagediff.main_text(df).collect()}
    assert got[0] == "one\nonly here" and got[1] == "two" and got[2] == "three\none"
    assert got[3] == "Welcome to the site\nAll about it\nalone\nCall us"
    assert got[4] == "no url" and got[5] == "" and got[6] == "All about it"


def test_copies_keep_their_text_and_repeats_stay(spark):
    url, html = site("/a/1", "one")
    df = spark.createDataFrame(
        [(1, url, html), (1, url, html), (2, url + "?x", html), (None, None, None)],
        "page_id long, url string, html string").repartition(2)
    got = pagediff.main_text(df).collect()
    assert sorted(len(r.text) for r in got) == [0, 44, 44, 44]
    assert all(r.n_chars == len(r.text) for r in got)
    assert pagediff.main_text(df.limit(0)).collect() == []


def test_long_pages():
    a = [str(i) for i in range(30_000)]
    b = a[:10_000] + ["new"] + a[15_000:]
    assert len(pagediff.common(a, b)) == 25_000


def test_a_site_line_inside_articles_goes_and_a_quoted_one_stays(spark):
    def body(i):
        quoted = "<p>They said so</p>" if i < 3 else ""
        return f"<nav>menu {i}</nav><article><p>Enjoy our offers</p><p>own {i}</p>{quoted}</article>"

    rows = [(i, f"http://h.example/a/{i}", body(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in pagediff.main_text(df).collect()}
    assert got == {i: f"own {i}" + ("\nThey said so" if i < 3 else "") for i in range(8)}


@pytest.mark.parametrize("named, expected", [
    ('<div class="entry-meta">May {i}</div><div>body {i}</div>', "May {i}\nbody {i}"),
    ('<div>body {i}</div><div class="post-date">May {i}</div>', "body {i}\nMay {i}"),
    ('<div class="story"><p>body {i}</p></div><article><p>teaser {i}</p></article>',
     "body {i}\nteaser {i}"),
    ('<div class="story"><p>body {i}</p></div><article><p>the same card</p></article>', "body {i}"),
])
def test_evidence_in_one_place_takes_nothing_elsewhere(spark, named, expected):
    site = "<div>Welcome to the site</div>{}<div>Call us</div>"
    rows = [(i, f"http://h.example/a/{i}", site.format(named.format(i=i))) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pagediff.main_text(df).collect()}
    assert got == {i: expected.format(i=i) for i in range(6)}


@pytest.mark.parametrize("page, lines", [
    ("<p>a<svg/><p>b", ["a", "b"]), ('<p>a<svg class="i"/><p>b<svg hidden />c<p>d', ["a", "bc", "d"]),
    ("<p>a<svg><text>no</text></svg><p>b", ["a", "b"]), ("<p>a<svg class=i/>no</svg><p>b", ["a", "b"]),
])
def test_self_closing_svg(page, lines):
    assert pagediff.lines_of(page)[0] == lines


@pytest.mark.parametrize("copies", [2, 3, 40])
def test_copies_lose_the_site_and_keep_the_article(spark, copies):
    def page(*own):
        return "".join(f"<div>{x}</div>" for x in ("Welcome", "All about it", *own, "Call us"))

    article = [f"paragraph {i}" for i in range(12)]
    rows, want = [], {}
    for i in range(copies):  # near copies, and an exact one of each
        text = [*article[:5], f"corrected {i}", *article[6:]]
        for j in (0, 1):
            rows.append((2 * i + j, f"http://h.example/a/{i:02}?{j}", page(*text)))
            want[2 * i + j] = "\n".join(text)
    for i in range(6):
        rows.append((1000 + i, f"http://h.example/b/{i}", page(f"own {i}", f"more {i}")))
        want[1000 + i] = f"own {i}\nmore {i}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in pagediff.main_text(df).collect()} == want


@pytest.mark.parametrize("page, text", [
    ('<main><div id="share-of-market"><p>a</p></div><section class="notice-period"><p>b</p></section></main>',
     ["a", "b"]),
    ('<article><p>a</p><div class="alert-levels"><p>b</p></div></article>', ["a", "b"]),
    ('<article><p>a</p><div class="notice"><p>b</p></div></article>', ["a", "b"]),
    ('<article><p>a</p></article><div class="notice">b</div><div class="share-bar left">c</div>', ["a"]),
    ('<div class="search-results-explained"><p>a</p></div><div class="site-search">b</div>', ["a"]),
])
def test_names_of_site_parts(spark, page, text):
    """A word inside a longer name says nothing, and inside the article no name takes text away."""
    df = spark.createDataFrame([(1, "http://h.example/a", page)], "page_id long, url string, html string")
    assert pagediff.main_text(df).first().text == "\n".join(text)


def test_shared_notice_inside_an_article_goes(spark):
    """Its name takes the guard of the article away; the pages of the host decide."""
    page = '<article><p>own %d</p><p>more %d</p><p>last %d</p><div class="notice">Read our terms</div></article>'
    rows = [(i, f"http://h.example/{i}", page % (i, i, i)) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in pagediff.main_text(df).collect():
        assert r.text == f"own {r.page_id}\nmore {r.page_id}\nlast {r.page_id}"
