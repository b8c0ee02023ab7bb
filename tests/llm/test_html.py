from __future__ import annotations

import html
import re

import pytest

from fitweave.llm import html_extract
from fitweave.llm.common import documents
from fitweave.llm.html_extract import Page, extract, main_text

SCHEMA = "page_id long, url string, html string, host string, path string"


def texts(spark, pages):
    rows = spark.createDataFrame([(n, u, h, "x", None) for n, (u, h) in enumerate(pages)], SCHEMA)
    return {r["page_id"]: r["text"] for r in extract(rows).collect()}


def own(page):
    return main_text(page, None)


LONG = "A sentence that carries the story of this page, long enough to count. " * 4


def test_article_of_the_tables(spark, sf):
    def plain(page):
        body = re.search("<article>(.*?)</article>", page, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", body)]
        return "\n".join(b for b in blocks if b)

    pages = documents(spark, sf, "pages")
    found = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    assert found == {r["page_id"]: plain(r["html"]) for r in pages.collect()}


@pytest.mark.parametrize(
    "extra",
    [
        "<nav><a href=x>menu</a></nav>", "<header>top</header>", "<footer>end</footer>", "<aside>side</aside>", "<form>name <input></form>",
        "<script>var a = '<p>no</p>'</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", '<div class="ad">buy</div>',
        '<div id="cookie-notice">we use</div>', '<section class="comments"><article class="comment"><p>first!</p></article></section>',
        '<ul class=menu><li><ul><li>in</li></ul></li><li>out</li></ul>', '<div role="navigation">go</div>', "<noscript>turn on</noscript>",
        '<div class="related-posts"><p>more</p></div>', "<button>go</button>",
    ],
)
def test_boilerplate_inside_an_article(extra):
    page = f"<html><body><article><h1>Title</h1><p>{LONG}</p>{extra}<p>Last &amp; least</p></article>out</body></html>"
    assert own(page) == f"Title\n{LONG.strip()}\nLast & least"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<p>a<b>b</b> <i>c</i>\n d</p>", "ab c d"), ("<p>one<p>two<li>three<li>four", "one\ntwo\nthree\nfour"), ("a<br>b", "a b"),
        ("&lt;x&gt; &eacute;&#233;&#xe9; a&nbsp;b", "<x> ééé a b"), ("1 < 2 <p>x</p>", "1 < 2\nx"), ("<table><tr><td>a<td>b</table>", "a\nb"),
        ("<p title='a > b'>x</p>", "x"), ("<p title='open>x</p>", "x"), ("<h2></h2><p> </p>x", "x"), ("<script>never closed <p>x", ""),
        ("<P CLASS=Ad>x</P><P>y</P>", "y"),
        ("<p title='a > b' id=\"c>'d\">x</p>", "x"),
        ("<p title=\"it's\">x</p><p>y's</p>", "x\ny's"),
        ("<!-- open <p>x", ""),
        ("<![CDATA[x]]>y<?php z ?>", "y"),
        ("x<svg><text>no</text></svg>y", "xy"),
    ],
)
def test_markup(body, text):
    assert own(f"<main>{body}</main>") == text


def test_host_consensus_beats_a_page_of_its_own(spark):
    good = f'<div class="page-7"><div class="story"><p>{LONG}</p></div><div class="links"><p>short</p></div></div>'
    odd = f'<div class="page-9"><div class="story"><p>Brief.</p></div><div class="links"><p>{LONG}</p></div></div>'
    pages = [("http://h.example/1", good)] * 5 + [("http://h.example/2", odd), ("http://other.example/", odd)]
    found = texts(spark, pages)
    assert found[5] == "Brief." and found[0] == LONG.strip()
    assert found[6] == LONG.strip()


def test_page_without_the_winning_path(spark):
    usual, other = f"<article><p>{LONG}</p></article>", f'<div class="text"><p>{LONG} Else.</p></div>'
    found = texts(spark, [("http://h.example/1", usual)] * 4 + [("http://h.example/2", other)])
    assert found[4] == f"{LONG}Else." .replace(".  ", ". ")


LEAD = "This lead is shorter than the story."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="content"><div class="intro"><p>{LEAD}</p></div><div class="body"><p>{LONG}</p></div></div>', f"{LEAD}\n{LONG}"),
        (f'<div class="content"><p>{LEAD}</p><div class="part"><p>{LONG}</p></div><div class="part"><p>{LONG}</p></div></div>', f"{LEAD}\n{LONG}\n{LONG}"),
        (f'<div class="content"><div class="title"><h1>Big news</h1></div><div class="body"><p>{LONG}</p></div></div>', f"Big news\n{LONG}"),
        (f'<div class="a"><div class="b"><div class="c"><p>{LONG}</p></div><div class="d"><p>{LEAD}</p></div></div><div class="e"><p>{LEAD}</p></div></div>', f"{LONG}\n{LEAD}\n{LEAD}"),
        (f'<div class="top"><a href=x>Home page of this site</a> <a href=y>All of our stories</a></div><div class="body"><p>{LONG}</p></div>', LONG),
        (f'<div class="top"><p><a href=x>Home page of this site</a></p></div><div class="intro"><p>{LEAD}</p></div><div class="body"><p>{LONG}</p></div>', f"{LEAD}\n{LONG}"),
        (f'<div class="body"><p>{LONG}</p><div class="sources"><p><a href=x>All of our sources</a></p></div></div>', f"{LONG}\nAll of our sources"),
        (f'<div class="ad">Buy now and save</div><div class="intro"><p>{LEAD}</p></div><nav>go</nav><div class="body"><p>{LONG}</p></div>', f"{LEAD}\n{LONG}"),
    ],
)
def test_sections_without_an_article(spark, page, text):
    text = "\n".join(line.strip() for line in text.split("\n"))
    page = f"<html><body>{page}</body></html>"
    assert own(page) == text
    assert texts(spark, [(f"http://h.example/{n}", page) for n in range(3)]) == {n: text for n in range(3)}


def test_pages_of_one_template_with_and_without_an_intro(spark):
    body = f'<div class="body"><p>{LONG}</p></div>'
    whole = f'<div class="content"><div class="intro"><p>{LEAD}</p></div>{body}</div>'
    found = texts(spark, [("http://h.example/", f'<div class="content">{body}</div>')] * 4 + [("http://h.example/i", whole)])
    assert found[0] == LONG.strip() and found[4] == f"{LEAD}\n{LONG.strip()}"


@pytest.mark.parametrize("empty", ["<article></article>", "<article><nav>menu</nav></article>", "<article> </article><article><p> </p></article>"])
def test_page_with_an_empty_element_on_the_winning_path(spark, empty):
    usual, other = f"<article><p>{LONG}</p></article>", f'{empty}<div class="text"><p>{LONG}</p></div>'
    assert texts(spark, [("http://h.example/1", usual)] * 4 + [("http://h.example/2", other)])[4] == LONG.strip()


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("a<svg/>b<p>c<svg><text>no</text></svg>d", "ab\ncd"), ("a<math />b<p>c", "ab\nc"), ("a<math><mi>x</mi></math>b", "axb"), ("a<iframe src=x>b<p>c", "ab\nc"),
        ("a<object>b<p>c<object>no</object>d", "ab\ncd"), ("a<svg><svg><text>no</text></svg><text>no</text></svg>b", "ab"),
        ("a<noscript>b<p>c", "ab\nc"), ("a<style>no<p>no", "a"), ("a<svg-icon>b</svg-icon><svg>no</svg>c", "abc"),
    ],
)
def test_raw_elements_without_an_end(body, text):
    assert own(f"<main>{body}</main>") == text


def test_beyond_the_broadcast_limit(spark, monkeypatch):
    pages = [(f"http://h{n % 9 and 1}.example/{n}", f"<article><p>{n} {LONG}</p></article>") for n in range(200)]
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", 0)
    assert texts(spark, pages) == {n: f"{n} {LONG}".strip() for n in range(200)}


def test_edges(spark):
    pages = [(None, None), (None, ""), ("", "plain text"), ("http://a.example/", "<p>x</p>"), ("http://a.example/", "<p>x</p>"), ("HTTP://A.example/y", "<nav>only</nav>")]
    assert texts(spark, pages) == {0: "", 1: "", 2: "plain text", 3: "x", 4: "x", 5: ""}
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("part", ["<div class='", '<a href="x>', "<", "<!--", "<script>", "</", "<p title='>", "<b a=\"'>"])
@pytest.mark.parametrize("end", ["", ">", "'>", "</div>"])
def test_broken_tags_in_linear_time(part, end):
    main_text(part * 50_000 + end, None)


@pytest.mark.parametrize("tag", ["svg", "iframe", "object", "svg a='"])
def test_unclosed_raw_elements_in_linear_time(tag):
    for part in (f"<{tag}>x", f"<{tag} ", f"<{tag}"):
        main_text(part * 50_000, None)
        main_text(part * 50_000 + ">", None)


@pytest.mark.parametrize("tag", ["div", "p", "li", "ul", "b", "td", 'div class="ad"'])
def test_deep_and_unclosed(tag):
    page = f"<{tag}>x" * 50_000
    Page(page)
    assert len(main_text(page, "div/div")) >= 0


@pytest.mark.parametrize("tag", ["div", "td", "section"])
def test_deep_pages_take_their_own_path_in_linear_time(tag):
    assert main_text(f"<{tag}>x" * 50_000, None).count("x") == 50_000


STORY = f"<h1>Title</h1><p>{LONG}</p>"
TOLD = f"Title\n{LONG.strip()}"


@pytest.mark.parametrize("word", sorted(html_extract.BOILERPLATE - html_extract.READERS))
def test_boilerplate_words_on_an_ancestor(word):
    for around in (word, f"has-{word}", f"page-{word}-wrapper"):
        for inner in (f"<article>{STORY}</article>", f"<main>{STORY}</main>", f"<div class=text>{STORY}</div>"):
            page = f'<html><body><nav><a href=x>go</a></nav><div class="{around}">{inner}</div><footer>end</footer></body></html>'
            assert own(page) == TOLD, (around, inner)


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar"><article>{STORY}</article></div>',
        f'<div id="page-header-wrapper"><main>{STORY}</main></div>',
        f"<form action=x><input name=state><div class=head><a href=x>go</a></div><article>{STORY}</article></form>",
        f"<form action=x><input name=state><div class=text>{STORY}</div></form>",
        f'<article>{STORY}</article><aside><article class="teaser"><p>Other story</p></article></aside>',
        f'<main>{STORY}</main><div class="related"><article><p>{LONG} {LONG}</p></article></div>',
        f'<article>{STORY}</article><section class="comments"><p>{LONG} {LONG} {LONG}</p></section>',
        f'<article>{STORY}<div class="comment-list"><article class="comment"><p>{LONG}</p></article></div></article>',
        f"<header><h1>Site</h1><a href=x>go</a></header><article>{STORY}</article>",
        f"<article><header><h1>Title</h1><nav>go</nav></header><p>{LONG}</p></article>",
    ],
)
def test_wrappers_keep_and_boilerplate_goes(page):
    assert own(f"<html><body>{page}</body></html>") == TOLD


def test_words_that_only_begin_like_boilerplate():
    page = f'<article><div class="social-history"><p>One.</p></div><p class="menu-description">Two.</p><p>{LONG}</p></article>'
    assert own(page) == f"One.\nTwo.\n{LONG.strip()}"
    assert own(f"<article><header><h1>Title</h1><p>Lead.</p></header><p>{LONG}</p></article>") == f"Title\nLead.\n{LONG.strip()}"
