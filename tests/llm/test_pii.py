from __future__ import annotations

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import edges, nothing

from fitweave.llm import pii
from fitweave.llm.common import documents
from fitweave.llm.queries import op8_pii


def good_card(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        total += int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10))
    return 14 <= len(digits) <= 19 and total % 10 == 0


def plain(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if good_card(only(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(only(m[0])) <= 15]
    return sorted(out)


@given(st.text(alphabet="a.@-+ 0123456789()5", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans(text):
    assert pii.spans_of(text)[0] == plain(text)


def test_long_runs_take_linear_time():
    """4 MB of a run before a sign that no domain follows, and of signs in a row."""
    started = time.perf_counter()
    for text in ("a" * 4_000_000 + "@.", "a@" * 2_000_000, "a.@" * 1_300_000, "a@" + "b-" * 2_000_000):
        assert pii.emails(text) == []
    assert len(pii.emails("a@b.c " * 600_000)) == 600_000
    assert time.perf_counter() - started < 30


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0001.2.3.4", "256.1.1.1", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112",
        "+1 (212) 555-0100", "++49 30 1234567890 ", "a.b+c%d@x-y.co.uk.", "@b.c", "1" * 5000, "+" * 500 + "1", "x@y", "9.9.9.9@h.de",
    ],
)
def test_base_samples(text):
    assert pii.spans_of(text)[0] == plain(text)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("write to jane [at] site [dot] org now", "email", "jane [at] site [dot] org"),
        ("jane.doe (AT) mail.site (Dot) org", "email", "jane.doe (AT) mail.site (Dot) org"),
        ("or kim at host dot example dot com today", "email", "kim at host dot example dot com"),
        ("jаne@sіte.org", "email", "jаne@sіte.org"),
        ("ｊａｎｅ＠ｓｉｔｅ．ｏｒｇ", "email", "ｊａｎｅ＠ｓｉｔｅ．ｏｒｇ"),
        ("ja​ne@si​te.org!", "email", "ja​ne@si​te.org"),
        ("call plus one two one two five five five zero one zero zero please", "phone", "plus one two one two five five five zero one zero zero"),
        ("ip １０.0.0.１", "ip", "１０.0.0.１"),
        ("ip 10 dot 20 dot 30 dot 40 up", "ip", "10 dot 20 dot 30 dot 40"),
        ("ip 10[.]20[.]30[.]40", "ip", "10[.]20[.]30[.]40"),
        ("ip one zero dot two dot three dot four", "ip", "one zero dot two dot three dot four"),
        ("mail jane.7 at site.org today", "email", "jane.7 at site.org"),
        ("mail jane @ site . org today", "email", "jane @ site . org"),
        ("card 4111 1111 l111 1I11", "card", "4111 1111 l111 1I11"),
        ("card " + "four " + "one " * 15 + "end", "card", "four" + " one" * 15),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    base, spans = pii.spans_of(text)
    assert base == []
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in spans] == [(kind, source)]


@pytest.mark.parametrize(
    "text",
    ["He arrived at noon point blank.", "one two three four five", "meet me at the dot", "look at site.org", "She left. At home, 3 at most.", "années, été – voilà · fin", "2020, 2021, 2022, 2023, 2024"],
)
def test_ordinary_text_is_left_alone(text):
    assert pii.spans_of(text) == ([], [])


def test_base_spans_stay_beside_new_ones():
    text = "a@b.org and 1.2.3.4 and c (at) d (dot) org"
    base, spans = pii.spans_of(text)
    assert base == plain(text) and set(base) < set(spans) and len(spans) == 3


PREFILTERS = [n for n in dir(pii) if n.startswith("HAS_")]


def without_prefilters(text):
    with pytest.MonkeyPatch.context() as patch:
        for name in PREFILTERS:
            patch.setattr(pii, name, re.compile(""))
        return pii.spans_of(text)


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("ip eight dot eight dot eight dot eight up", "ip", "eight dot eight dot eight dot eight"),
        ("ip acht punkt 8 punkt acht punkt acht up", "ip", "acht punkt 8 punkt acht punkt acht"),
        ("ip 0010 punkt 20 punkt 30 punkt 40 up", "ip", "0010 punkt 20 punkt 30 punkt 40"),
        ("ip fİve dot fİve dot fİve dot fİve up", "ip", "fİve dot fİve dot fİve dot fİve"),
        ("mail jane@example. com today", "email", "jane@example. com"),
        ("mail jane@example  .com today", "email", "jane@example  .com"),
        ("mail jane.7 at site.-x.org today", "email", "jane.7 at site.-x.org"),
    ],
)
def test_prefilters_let_through_what_their_pattern_matches(text, kind, source):
    base, spans = pii.spans_of(text)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in spans if (s, k, e) not in base] == [(kind, source)]
    assert (base, spans) == without_prefilters(text)


PIECES = [
    "one", "Eight", "fünf", "ZÉRO", "un", "plus", "fİve", "7", "10", "0020", "dot", "Punkt", "punto", "point", "at", "chez", "[at]", "(dot)", "jane.7",
    "kim", "@", ".", ",", "-", " ", "  ", "   ", "x@", "@y", "site", "com", "org", "de", "O", "l", "\n", "\u200b", "ａ",
]


@given(st.lists(st.sampled_from(PIECES), max_size=24), st.sampled_from(["", " "]))
@settings(max_examples=1500, deadline=None)
def test_prefilters_change_nothing(pieces, between):
    text = between.join(pieces)
    assert pii.spans_of(text) == without_prefilters(text)


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf).collect()}
    for r in op8_pii(spark, sf).collect():
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [base.count(k + ":") for k in pii.KINDS]


def test_edges(spark):
    rows = pii.find_pii(edges(spark)).collect()
    assert len(rows) == edges(spark).count()
    assert all(r["spans"] == [] for r in rows)
    assert pii.find_pii(nothing(spark)).collect() == []
