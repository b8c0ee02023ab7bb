from __future__ import annotations

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import edges, frame, nothing

from fitweave.llm import secrets
from fitweave.llm.common import documents
from fitweave.llm.queries import op3_secrets

WORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


SAMPLES = [
    "token = 'abcdef123'", "PassWord:x", "API_KEY=\"AbC.def/+1\" apikey : zzzzzz", "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "A1" * 8,
    "AKIA" + "A" * 15, "é\U0001f600 secret= 0123456789abcdef0123456789abcdef", "f" * 23, "f" * 24, "password = token = abcdefgh",
    "x" * 3_000_000 + " secret: abcdef", "-----BEGIN RSA PRIVATE KEY-----", "tok\0en=abcdef",
]


def test_samples_and_blocks(spark):
    texts = SAMPLES * 3
    rows = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(frame(spark, enumerate(texts))).collect()}
    kinds = {r.name for r in secrets.BASE_RULES}
    for n, text in enumerate(texts):
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in rows[n] if s["kind"] in kinds) == plain(text)
    assert [s["kind"] for s in rows[11]] == ["private_key"]


@given(st.lists(st.text(alphabet="akitoken:= 'AKI0fSpws", max_size=60), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_index_loses_nothing(texts):
    rules = (*secrets.RULES, secrets.Rule("short", "k=."), secrets.Rule("either", "(?:token|(?:ak)+i[a-f]?0)"))
    scan = secrets._scanner(rules)
    for text, spans in zip(texts, scan(texts), strict=True):
        full = sorted((s, n, e) for n, r in enumerate(rules) for s, e in r.spans(re.compile(r.pattern, r.flags), text))
        assert [(x["start"], x["kind"], x["end"]) for x in spans] == [(s, rules[n].name, e) for s, n, e in full]


@given(st.lists(st.sampled_from(["eyJ", "eyJabcdefgh", "ABCDEFGH", "x", ".", ".eyJ", "-", " ", "é", "12345678"]), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_linear_form_finds_the_same_tokens(text):
    rule = next(r for r in secrets.RULES if r.linear)
    assert rule.spans(re.compile(rule.linear, rule.flags), text) == rule.spans(re.compile(rule.pattern, rule.flags), text)


def test_long_runs_take_linear_time():
    texts = ["eyJ" * 1_300_000, "token=" * 700_000, "f" * 4_000_000, "eyJabcdefgh." * 300_000]
    started = time.perf_counter()
    list(secrets._scanner(secrets.RULES)(texts))
    assert time.perf_counter() - started < 30


@pytest.mark.parametrize(
    ("pattern", "query"),
    [
        ("abcd", {frozenset({"abc", "bcd"})}),
        ("abc|xyz", {frozenset({"abc"}), frozenset({"xyz"})}),
        ("ab?c", {frozenset()}),
        ("[0-9]+", {frozenset()}),
        ("(?:abc)+x*def", {frozenset({"abc", "def"})}),
        ("a[bc]d", {frozenset({"abd"}), frozenset({"acd"})}),
        ("(?:abc)*", {frozenset()}),
    ],
)
def test_mandatory_trigrams(pattern, query):
    assert set(secrets.mandatory(pattern)) == query


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf).collect()}
    for r in op3_secrets(spark, sf).collect():
        spans = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [spans.count(k + ":") for k in ("assign", "access", "hex")]


def test_edges(spark):
    rows = secrets.find_secrets(edges(spark)).collect()
    assert len(rows) == edges(spark).count()
    assert all(r["spans"] == [] for r in rows)
    assert secrets.find_secrets(nothing(spark)).collect() == []
