from __future__ import annotations

import pytest

from fitweave.sources.pages import clean_page, clean_pages, quarantined_pages, recognizable_html


def body(inner: str) -> str:
    return f"<!doctype html><html><body>{inner}</body></html>"


def markdown(inner: str) -> str:
    return clean_page(body(f"<article>{inner}</article>"))[1]


@pytest.mark.parametrize(
    ("inner", "expected"),
    [
        ("<h1>Lock\n keeper</h1><p>Opens  the lock.</p>", "# Lock keeper\n\nOpens the lock."),
        ("<h4>Tools</h4>rope", "#### Tools\n\nrope"),
        ("<ul><li>oars</li><li>sails</li></ul>", "- oars\n- sails"),
        ("<ul><li>oars<li>sails<li>rope</ul>", "- oars\n- sails\n- rope"),
        ("<ul><li>boats<ul><li>canoe</li><li>barge</li></ul></li><li>rope</li></ul>", "- boats\n  - canoe\n  - barge\n- rope"),
        ("<ol><li>lift</li><li>turn</li></ol>", "1. lift\n2. turn"),
        ("<ol start=9><li>nine</li><li>ten<ul><li>half</li></ul></li></ol>", "9. nine\n10. ten\n    - half"),
        ("<table><tr><th>boat</th><th>crew</th></tr><tr><td>punt</td><td>1</td></tr></table>", "| boat | crew |\n| --- | --- |\n| punt | 1 |"),
        ("<table><tbody><tr><td>punt</td><td>a|b</td></tr><tr><td>raft</td></tr></tbody></table>", "|  |  |\n| --- | --- |\n| punt | a\\|b |\n| raft |  |"),
        ("<blockquote>calm<p>water</p></blockquote>", "> calm\n>\n> water"),
        ("<pre>row\n  row\tboat</pre>", "```\nrow\n  row\tboat\n```"),
        ("<p><code>a</code> <code>b`c</code> <kbd>Esc</kbd></p>", "`a` ``b`c`` `Esc`"),
        ("<p><b>bold</b> <i>thin</i> <del>gone</del> <b> </b></p>", "**bold** *thin* ~~gone~~"),
        ("<p>one<br>two</p><hr><p>three</p>", "one  \ntwo\n\n---\n\nthree"),
        ("<p><a href='/x'>here</a> <a>plain</a> <img src=s alt=t></p>", "[here](/x) plain ![t](s)"),
        ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
    ],
)
def test_markdown(inner, expected):
    assert markdown(inner) == expected


@pytest.mark.parametrize(
    "furniture",
    ["<nav>x</nav>", "<header>x</header>", "<footer>x</footer>", "<aside>x</aside>", "<form>x</form>", "<script>x</script>", "<style>x</style>",
     "<div aria-hidden=true>x</div>", "<p class='big Cookie-box'>x</p>", "<p id=consentLayer>x</p>", "<svg><text>x</text></svg>", "<!-- x -->"],
)
def test_furniture_goes(furniture):
    title, text, plain, removed, _ = clean_page(body(f"<main><h1>Ferry pilot</h1>{furniture}<p>Night shifts.</p></main>"))
    assert (title, text, plain, removed) == ("Ferry pilot", "# Ferry pilot\n\nNight shifts.", "Ferry pilot Night shifts.", False)


def test_embedded_document_is_opened():
    inner = "&lt;body&gt;&lt;h2&gt;Duties&lt;/h2&gt;&lt;p&gt;Steer &amp;amp; moor.&lt;/p&gt;&lt;/body&gt;"
    assert clean_page(body(f"<main><h1>Pilot</h1><iframe srcdoc='{inner}'></iframe></main>"))[1] == "# Pilot\n\n## Duties\n\nSteer & moor."
    assert clean_page(body("<main>kept<iframe srcdoc=' '>gone</iframe></main>"))[1] == "kept"


def test_block_with_details_wins_over_a_longer_one():
    cards = "<main><h2>Similar jobs</h2>" + "<p>Harbour cook on a big ship</p>" * 30 + "</main>"
    page = body(cards + "<article><h1>Pilot</h1><h2>Responsibilities</h2><p>Steer.</p></article>")
    title, text, _, removed, score = clean_page(page)
    assert (title, text, removed, score) == ("Pilot", "# Pilot\n\n## Responsibilities\n\nSteer.", False, 800)
    long_one, longer = "a" * 20_000, "b" * 20_080
    assert clean_page(body(f"<article>{long_one}</article><article>{longer}</article>"))[2] == longer
    assert clean_page(body("<p>no block</p>"))[1:] == ("no block", "no block", False, None)


def test_related_sections():
    kept = "<h1>Pilot</h1><p>Steer.</p>"
    for inner, text in [
        (kept + "<section><h2>Recommended jobs</h2><p>Cook</p></section><p>End.</p>", "# Pilot\n\nSteer.\n\nEnd."),
        (kept + "<h3>Weitere Stellenangebote</h3><p>stays</p>", "# Pilot\n\nSteer.\n\nstays"),
        (kept + "<div><span><h5>related <b>jobs</b></h5></span>x</div>", "# Pilot\n\nSteer."),
    ]:
        found = clean_page(body(f"<article>{inner}</article>"))
        assert (found[1], found[3]) == (text, True)
    assert clean_page(body(f"<div><article>{kept}<h2>Similar jobs</h2></article></div>"))[1] == ""


def test_titles_fall_back_in_order():
    social = "<meta name='twitter:title' content='Bird'><meta property='og:title' content=' Graph '>"
    assert clean_page(f"<html><head>{social}<title>T</title></head></html>")[0] == "Graph"
    assert clean_page("<html><head><meta name='twitter:title' content='Bird'><title>T</title></head></html>")[0] == "Bird"
    assert clean_page("<html><head><title> T </title></head><body><h1> </h1></body></html>")[0] == "T"
    assert clean_page("<html><body></body></html>")[0] is None


@pytest.mark.parametrize("opening", ["<p>a", "<ul><li>a", "<li>a", "<div>", "<b>", "<table><tr><td>a", "<article>", "<h2>similar jobs", "<blockquote>"])
def test_unclosed_and_deep(opening):
    times = 300 if opening in ("<ul><li>a", "<blockquote>", "<table><tr><td>a") else 100_000
    title, text, plain, _, _ = clean_page(body(opening * times + "end") + "</p></div></b>" * 1000)
    assert title is None and (plain.endswith("end") or "similar" in opening)
    assert text or "similar" in opening


def test_pages_as_a_job(spark):
    filler = "<!-- " + "x" * 20_000 + " -->"
    pages = spark.createDataFrame(
        [(1, "u", body("<h1>Pilot</h1>")), (2, "u", "plain text"), (3, "u", None), (4, "u", filler + body("<h1>Late</h1>"))],
        "page_id bigint, url string, html string",
    )
    assert {r["page_id"]: r["title"] for r in clean_pages(recognizable_html(pages)).collect()} == {1: "Pilot", 4: "Late"}
    assert {r["page_id"]: r["reason"] for r in quarantined_pages(pages).collect()} == {2: "not html", 3: "no content"}
    assert {r["page_id"]: r["reason"] for r in quarantined_pages(pages, 1000).collect()} == {2: "not html", 3: "no content", 4: "too large"}
    assert clean_pages(pages.where("false")).count() == 0
