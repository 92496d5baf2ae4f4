import pytest
from pyspark.sql import functions as F

from docvet.llm import html_main as H

LONG = "The house that was built on the hill is one of the oldest in the town and it has been there for all of the years that they can remember, with its garden and its wall."
PAGES = {
    "plain article": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer></body></html>", f"A & B {LONG} Short."),
    "broken markup": (f"<body><article><h1>T</h1><p><b>{LONG}<br><p>next   one\n</article><div class='ad'>{LONG}</div>", f"T {LONG} next one"),
    "no article": (f"<body><div id=menu><a href=a>One</a> <a href=b>Two</a></div><h1>Title</h1><p>{LONG}</p><p>Yes.</p><p>{LONG} {LONG}</p><ul><li><a href=x>{LONG}</a></li><li><a href=y>More of this</a></li></ul><div>&copy; 2020 x</div></body>", f"Title {LONG} Yes. {LONG} {LONG}"),
    "parts to drop": (f"<main><aside>{LONG}</aside><p>{LONG}</p><div class='cookie-notice'>{LONG}</div><form><p>{LONG}</p></form><script>var a='</p>';</script><section id='comments'><article><p>{LONG}</p></article></section><p style='display:none'>{LONG}</p></main>", LONG),
    "references": ("<article><p>1 &lt; 2 &amp;amp; &eacute;&#233;&#xe9; a&nbsp;&nbsp;b &unknown; &am</p></article>", "1 < 2 &amp; ééé a b &unknown; &am"),
    "inline": (f"<article><p>o<b>n</b>e <i>two</i><span>three</span> {LONG}</p></article>", f"one twothree {LONG}"),
    "comment and raw": (f"<article><!-- <p>no</p> --><p>{LONG}</p><textarea><p>x</textarea><!-- open", LONG),
    "header in article": (f"<header>{LONG}</header><article><header><h2>Head</h2></header><p>{LONG}</p></article>", f"Head {LONG}"),
    "nothing": ("<html><body></body></html>", ""),
    "stray signs": (f"<article><p>a < b and c > d {LONG}</p><p title=\"x>y\">{LONG}</p></article>", f"a < b and c > d {LONG} {LONG}"),
    "only text": (LONG * 2, LONG * 2),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert H.main_text(page) == want


def test_two_passes():
    b = lambda n, links=0: H.Block(("the cat of and " * 30)[:n], links, False, False)
    assert H.labels([b(30), b(300), b(30), b(30), b(100, 90), b(30), b(30), b(300)]) == [True, True, True, False, False, False, True, True]


def test_long_pages_end_in_time():
    H.main_text("<" * 300_000 + "a 'b\" " * 50_000)
    assert H.main_text("<p>" * 100_000 + LONG) == LONG
    assert H.main_text(f"<article>{'<p>' + LONG} " * 20_000).count("house") == 20_000
    H.main_text("<a href='x " * 30_000)


def test_extract(spark):
    rows = [(1, "u", PAGES["broken markup"][0]), (2, None, None), (3, "v", ""), (None, "w", "<p>x"), (1, "u", PAGES["broken markup"][0])]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == sorted((str(i), t, len(t)) for i, t in [(1, PAGES["broken markup"][1])] * 2 + [(2, ""), (3, ""), (None, "")])
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table_against_the_article_elements(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside))).split())


def test_an_article_element_is_only_a_sign():
    card = "<article><h3>Read more</h3><p>See our other story.</p></article>"
    assert H.main_text(f"<body><h1>Title</h1><div>{LONG}</div><p>{LONG} {LONG}</p><ul><li><a href=x>{LONG}</a></li></ul>{card}<p>&copy; x</p></body>") == f"Title {LONG} {LONG} {LONG}"
    assert H.main_text(f"<body>{card}<div>{LONG} {LONG}</div><div>{LONG}</div></body>").endswith(f"{LONG} {LONG} {LONG}")
    codes = "zx81 qwerty asdf " * 8
    assert H.main_text(f"<body><p>Menu</p><article><p>{LONG}</p><p>{codes}</p><p>So.</p></article><p>{LONG}</p><p>{codes}</p></body>") == f"{LONG} {codes.strip()} So. {LONG}"


def test_hidden_elements():
    for attribute in ("hidden", 'hidden=""', "hidden='hidden'", "HIDDEN=until-found", 'aria-hidden="true"', "style='visibility: hidden'"):
        assert H.main_text(f"<article><div {attribute}>{LONG}</div><p>{LONG}</p></article>") == LONG
    assert H.main_text(f"<article><p title='the hidden gem' data-hidden=x aria-hidden=false>{LONG}</p></article>") == LONG


def test_broken_pages_take_time_in_proportion():
    import time

    began = time.time()
    for part in ('<a "', '<a ">" ', "<a href='x ", "<div></span>", "<a ", "<!-- ", "<b><div></i>", '<a b="', "<p class ", "</p ", "<script>"):
        H.main_text(part * 100_000 + "<p>x</p>" + part * 10)
    assert time.time() - began < 60


def test_whole_table_without_article_elements(spark, sf):
    import re

    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    bare = [(i, u, re.sub("<(/?)(?:article|main)>", r"<\1div>", h)) for i, u, h in pages]
    want, got = ({r.page_id: r.text.split() for r in H.extract(spark.createDataFrame(x, "page_id long, url string, html string")).collect()} for x in (pages, bare))
    common = sum(len(set(want[i]) & set(got[i])) for i in want)
    assert common >= 0.9 * sum(len(set(w)) for w in want.values()) and common >= 0.9 * sum(len(set(w)) for w in got.values())
