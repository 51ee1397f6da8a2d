import html
import re
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from samples import rows_of

from reviewmill.llm.page_text import extract, main_text
from reviewmill.llm.queries import QUERIES

PAGE = "page_id bigint, url string, html string"
LONG = "The council met on Monday, and after a long debate it agreed to rebuild the old bridge. Work starts in May."
MORE = "Residents had asked for it since the flood of last year; the mayor, who had long refused, gave in at last."
SHORT = "It rained."
COOKIES = "We use cookies, and our partners do too. You may refuse them, at any time, in your browser."
ADVERT = "Buy two, get one free! Our shoes are light, warm, and they last for years."
COMMENT = "I have lived here for years, and I say that this is the best news. Well done, all of you!"
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "Home News Sport Weather Contact".split())
BODY = f"<p>{LONG}</p><p>{MORE}</p><p>{SHORT}</p><p>{LONG} {MORE}</p>"
TEXT = f"Bridge to be rebuilt {LONG} {MORE} {SHORT} {LONG} {MORE}"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Site</title>{head}</head><body>{body}</body></html>"


LAYOUTS = {
    "article": f"<nav><ul>{MENU}</ul></nav><article><h1>Bridge to be rebuilt</h1>{BODY}</article><footer>&copy; us</footer>",
    "main": f"<header><h1>Site</h1></header><main><h1>Bridge to be rebuilt</h1>{BODY}</main><aside><p>{ADVERT}</p></aside>",
    "header in article": f"<article><header><h1>Bridge to be rebuilt</h1></header>{BODY}<footer>By us, 2020.</footer></article>",
    "classes": f'<div class="top-nav"><ul>{MENU}</ul></div><div id="wrap"><div class="post"><h1>Bridge to be rebuilt</h1>{BODY}</div>'
    f'<div class="sidebar-left"><p>{ADVERT}</p></div></div><div id="pageFooter"><p>All rights reserved, 2020.</p></div>',
    "no words": f"<div><ul>{MENU}</ul></div><div><div><h1>Bridge to be rebuilt</h1>{BODY}</div></div><div><a href=x>Imprint</a></div>",
    "table": f"<table><tr><td><ul>{MENU}</ul><td><h1>Bridge to be rebuilt</h1>{BODY}</table>",
    "notices": f'<div class="cookie-notice"><p>{COOKIES}</p></div><div role="dialog"><p>{COOKIES}</p></div>'
    f'<article class="has-sidebar"><h1>Bridge to be rebuilt</h1>{BODY}</article>',
    "adverts": f'<div class="ad">{ADVERT}</div><article><h1>Bridge to be rebuilt</h1><p>{LONG}</p><div class="advert"><p>{ADVERT}</p></div>'
    f"<p>{MORE}</p><p>{SHORT}</p><p>{LONG} {MORE}</p></article>",
    "comments": f'<article><h1>Bridge to be rebuilt</h1>{BODY}</article><section id="comments">'
    + "".join(f'<article class="comment"><p>{COMMENT} {i}</p></article>' for i in range(9))
    + "</section>",
    "comments within": f'<article><h1>Bridge to be rebuilt</h1>{BODY}<div class="commentList"><p>{COMMENT}</p><p>{COMMENT}</p></div></article>',
    "form around all": f"<form><article><h1>Bridge to be rebuilt</h1>{BODY}</article><select><option>A, b.<option>C.</select></form>",
    "form": f"<article><h1>Bridge to be rebuilt</h1>{BODY}<form><p>{COOKIES}</p><textarea>x, y.</textarea></form></article>",
    "scripts": f"<article><h1>Bridge to be rebuilt</h1><script>if (a < b) {{ '</p>' }}</script>{BODY}<style>p > b {{}}</style><!-- <p>x, y.</p> --></article>",
    "unclosed": f"<nav><ul><li>Home<li>News</ul></nav><article><h1>Bridge to be rebuilt</h1><p>{LONG}<p><b>{MORE}<br><p>{SHORT}<p>{LONG} {MORE}",
    "misnested": f"<article><h1>Bridge <i>to be</h1></i>rebuilt<p>{LONG}</p><b><p>{MORE}</b></p><p>{SHORT}</p><div>{LONG} {MORE}</article>",
    "table of contents": f"<article><ul>{MENU}</ul><h1>Bridge to be rebuilt</h1>{BODY}</article>",
    "lists": f"<article><h1>Bridge to be rebuilt</h1><ul><li>{LONG}<li>{MORE}</ul><dl><dt>{SHORT}<dd>{LONG} {MORE}</dl></article>",
    "heading before": f"<h1>Bridge to be rebuilt</h1><div class=content>{BODY}</div><div><ul>{MENU}</ul></div>",
    "two articles": f'<main><article><h1>Bridge to be rebuilt</h1>{BODY}</article><article class="related"><h2>Other</h2><p>{ADVERT}</p></article></main>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert main_text(page(LAYOUTS[name])) == TEXT
    assert main_text(LAYOUTS[name].replace("><", ">\n  <")) == TEXT


def test_white_space_and_references():
    source = "<article><p> a&nbsp;b\n\t c&amp;lt; &eacute;&#233;&#xe9; x&lt;y &unknown; 1 < 2 &amp</p><p>foo<b>bar</b>baz<br>qux</p></article>"
    assert main_text(source) == "a b c&lt; \xe9\xe9\xe9 x<y &unknown; 1 < 2 & foobarbaz qux"


@pytest.mark.parametrize("source", [None, "", "   ", "<html></html>", "<script>x", "<!-- x", "<nav><a>x</a></nav>", "<p", "</p></x><!>"])
def test_without_content(source):
    assert main_text(source) == ""


def test_short_pages_stay_whole():
    assert main_text("<article><h1>Hi</h1><p>x</p></article><footer>A long, long footer. With sentences, too.</footer>") == "Hi x"
    assert main_text("<p>word</p>") == "word" and main_text("just text") == "just text"


def test_odd_markup_ends():
    for source in ("<a <a <a " * 20_000, "<div>" * 20_000 + "x", '<a b="' * 20_000, "<!--" * 20_000, "<b><p>" * 5_000 + "</b>" * 5_000, "&" * 50_000):
        start = time.perf_counter()
        main_text(source)
        assert time.perf_counter() - start < 20


def test_very_long_page():
    body = "".join(f"<p>{LONG} {i}.</p>" for i in range(20_000))
    assert main_text(page(f"<nav>{MENU}</nav><article>{body}</article>")) == " ".join(f"{LONG} {i}." for i in range(20_000))


@settings(max_examples=200, deadline=None)
@given(st.text("<>/abp!-=\"' &;\n", max_size=60))
def test_any_text_is_read(source):
    main_text(source)
    assert main_text(f"<article><p>{html.escape(source)}</p></article>") == " ".join(source.split())


def test_edge_rows(spark):
    rows = [(1, "http://a.b/", page(LAYOUTS["article"])), (2, None, None), (None, "x", "<p>y"), (2, None, ""), (2, None, "<p>z</p>")]
    pages = spark.createDataFrame(rows, PAGE)
    wanted = sorted([(1, "http://a.b/", TEXT, len(TEXT)), (2, None, "", 0), (None, "x", "y", 1), (2, None, "", 0), (2, None, "z", 1)], key=repr)
    assert rows_of(extract(pages)) == wanted
    clashing = pages.withColumns({name: F.lit(7) for name in ("key", "text", "n_chars", "path")})
    assert rows_of(extract(clashing)) == wanted
    assert extract(spark.createDataFrame([], PAGE)).count() == 0


def test_query_over_the_test_tables(spark, sf_dir):
    found = {r.page_id: r for r in QUERIES["op12_tag_path_ratios"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(pages)
    for row in pages:  # the article of the test pages, without its tags
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", row.html, re.S)[1]
        body = re.sub(r"</?b>", "", body)
        wanted = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
        assert found[row.page_id].text == wanted and found[row.page_id].n_chars == len(wanted)
