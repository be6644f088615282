import html
import re

import pytest
from brute import told
from conftest import SMALL
from pyspark.sql import functions as F

from quayline.llm import catalog
from quayline.llm.extraction import extracted, main_text

LONG = "A paragraph of the article, with commas, and enough words to look like one."
CASES = {
    "": "",
    "<html><head><title>x</title></head><body></body></html>": "",
    "just text &lt;b&gt; &amp; more": "just text <b> & more",
    '<p title="a > b">x &eacute; &#233; &#x263A;&nbsp; y</p>': "x é é ☺ y",
    f"<body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id=main class=has-sidebar><div class=post><h1>T</h1><p>{LONG}</p>"
    f"<p>Short.</p><ul><li>one<li>two</ul></div><div class=sidebar><p>{LONG}</p></div><div id=comments><p>{LONG} {LONG}</p></div></div>"
    "<footer>c</footer></body>": f"T\n\n{LONG}\n\nShort.\n\none\n\ntwo",
    f"<body><article><p>One, two.</p><aside>related</aside><form><p>{LONG}</p></form><div class='ad'>Buy, now</div><p>Three.</p>"
    "<div class=share><a href=x>Post</a></div></article></body>": "One, two.\n\nThree.",
    f"<main><article><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2><p>Bb</p></section></article>"
    f"<article class='comment'><p>{LONG}</p></article></main>": f"A\n\n{LONG}\n\nB\n\nBb",
    f"<div><div>{LONG}</div><div>More, here.<br>and lines</div></div><div class='cookie-notice'>{LONG} {LONG}</div>": f"{LONG}\n\nMore, here. and lines",
    f"<article><p><b>{LONG}<br><p>Next <i>one</b> two</i>": f"{LONG}\n\nNext one two",
    f"<article><p>{LONG}</p><script>var t='</p><p>no</p>';</script><!-- <p>no</p> --><p hidden>no</p><p style='display: none'>no</p><p>x &am": f"{LONG}\n\nx &am",
    "<div>" * 3000 + f"<p>{LONG}</p>": LONG,
    f"<body><p>{LONG}</p><ul class=related><li><a href=x>a link</a></ul><ul><li><a href=x>{LONG}</a><li><a href=y>z</a></ul></body>": LONG,
}


@pytest.mark.parametrize("page", CASES)
def test_pages(page):
    assert main_text(page) == CASES[page]


def plain(page):
    """The text between the article's tags; the given pages have no clutter within it."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)[1]
    parts = re.sub(r"</?(?:p|h1)>", "\0", inner).replace("<br>", " ")
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", part)).split()) for part in parts.split("\0"))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = told(catalog.QUERIES["op2_html_extraction"](spark, SMALL), "page_id", "url", "text", "n_chars")
    want = [(r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in pages]
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", f"<p>{LONG}</p>"), (3, "w", f"<p>{'x, ' * 60_000}</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "more": F.lit(2)})
    got = extracted(df)
    assert got.columns == ["page_id", "url", "more", "text", "n_chars"]
    assert told(got, "page_id", "n_chars") == [(None, len(LONG)), (1, 0), (1, 0), (2, 0), (3, 179_999)]
    assert told(extracted(df.limit(0))) == []


LINKS = "<li><a href=x>The first source of it</a><li><a href=y>The second source</a>"
KEPT = {
    f"<article><p>{LONG}</p><ul class='wp-block-list'><li>one<li>two</ul></article>": f"{LONG}\n\none\n\ntwo",
    f"<article><p>{LONG}</p><section id=tools><h2>T</h2><p>Saw.</p></section></article>": f"{LONG}\n\nT\n\nSaw.",
    f"<article><p>{LONG}</p><section id='related-work'><h2 id=related>R</h2><p>Old.</p></section></article>": f"{LONG}\n\nR\n\nOld.",
    f"<article><p class='skip-dropcap'>{LONG}</p><div class='extra-notes'>More.</div></article>": f"{LONG}\n\nMore.",
    f"<article><p>{LONG}</p><h2>Sources</h2><ol>{LINKS}</ol></article>": f"{LONG}\n\nSources\n\nThe first source of it\n\nThe second source",
    f"<body><div class=post><p>{LONG}</p><div class='side-note'>Aside.</div><ul class='wp-block-list'>{LINKS}, 2019</ul></div><div class='side-bar'>no</div></body>":
        f"{LONG}\n\nAside.\n\nThe first source of it\n\nThe second source, 2019",
    f"<body><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><table class='list meta'><tr><td>1<td>2</table><h2>Sources</h2><ul>{LINKS}</ul></body>":
        f"{LONG}\n\n{LONG}\n\n{LONG}\n\n1\n\n2\n\nSources\n\nThe first source of it\n\nThe second source",
}
CLUTTER = {
    f"<article><p>{LONG}</p><ul class='related-links'>{LINKS}</ul><div class='social-share'>Post</div><div class=tags>x</div></article>": LONG,
    f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div class='cookie-text'>{LONG} {LONG}</div><ul>{LINKS}</ul></body>": f"{LONG}\n\n{LONG}",
}


@pytest.mark.parametrize("page", KEPT)
def test_words_of_names_in_the_article(page):
    assert main_text(page) == KEPT[page]


@pytest.mark.parametrize("page", CLUTTER)
def test_clutter(page):
    assert main_text(page) == CLUTTER[page]


#: Parts of a page that are clutter by their name alone, and parts that are not.
GOES = [
    '<div class="user-comments">', '<section id="user-comments">', '<div class="comment-list">', '<ol class="commentlist">',
    '<div class="post-comments">', '<div id="respond">', '<div class="ad-slot">', '<div class="ad-container">', '<div class="adbox">',
    '<div class="sponsored-content">', '<div class="share-bar">', '<div class="subscribe-box">', '<div class="site-notice">',
    '<div class="article-sidebar">', '<div class="article-footer">', '<div id="commentList2">', '<section class="comments-area">',
    '<div class="ad ad-top">', '<ul class="comment-items">', '<div class="newsletter-form">', '<div class="cookie-banner">',
    '<div class="related-posts-box related">', '<p class="advertisement">', '<p class="cookie-notice">', '<div class="post-navigation">',
    '<div id="ad-slot-3">', '<section class="reader-comments">', '<div class="sidebar-inner">', '<div class="promo-block">', '<table class="ad">',
]
STAYS = [
    '<p class="social">', '<p class="search">', '<p id="promotion">', '<p class="skip-dropcap">', '<section id="related-work">',
    '<section id="tools">', '<section id="search">', '<div class="side-note">', '<div class="extra-notes">', '<ul class="wp-block-list">',
    '<div class="has-sidebar">', '<div class="no-comments">', '<p class="navigation">', '<div class="article-text">', '<table class="list meta">',
    '<div class="entry-content">', '<section id="social-history">', '<div class="address">', '<div class="readable">', '<div class="adaptation">',
]


def fragment(start):
    tag = start[1:].split()[0]
    inner = {"ul": "<li>Z, words here.</li>", "ol": "<li>Z, words here.</li>", "table": "<tr><td>Z, words here.</td></tr>", "p": "Z, words here."}
    return f"{start}{inner.get(tag, '<p>Z, words here.</p>')}</{tag}>"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<body><div class=wide>{}</div></body>"])
@pytest.mark.parametrize("start", GOES + STAYS)
def test_names_of_parts(start, around):
    page = around.format(f"<h2>T</h2><p>{LONG}</p>{fragment(start)}<p>{LONG}</p>")
    assert ("Z, words here." in main_text(page)) == (start in STAYS)
    assert main_text(page).count(LONG) == 2


def test_points_choose_the_container():
    page = (f"<body><div id=a><div><a href=x>{LONG}</a><a href=y>{LONG}</a></div></div><div id=b><div>{'<p>' + LONG + '</p>'}<p>One, two, three.</p></div></div>"
            f"<div id=c><p>Few words</p></div></body>")
    assert main_text(page) == f"{LONG}\n\nOne, two, three."
