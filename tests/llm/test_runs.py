from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import edges, frame, nothing

from fitweave.llm import queries, runs


def brute(words, least=runs.LEAST):
    """Every period of every stretch, directly."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        at = 0
        while at + p < n:
            if words[at] == words[at + p]:
                end = at
                while end + p < n and words[end] == words[end + p]:
                    end += 1
                if end + p - at >= max(least, 2 * p):
                    found.setdefault((at, end + p), p)
                at = end
            at += 1
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def ours(words):
    rows = runs.runs_of(np.array([*words, 10**6], np.int64))
    return [(int(a), int(b - a), int(p)) for a, b, p in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=14), st.integers(1, 6)), max_size=8))
def test_repeated_stretches(parts):
    words = [w for part, times in parts for w in part * times]
    assert ours(words) == brute(words)


def test_meeting_and_overlapping_stretches():
    rng = random.Random(3)
    for _ in range(150):
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
        other = unit[rng.randrange(len(unit)) :] + unit
        words = unit * rng.randrange(1, 20) + other * rng.randrange(1, 12) + [rng.randrange(3)] * rng.randrange(2)
        words = words * rng.randrange(1, 4)
        assert ours(words) == brute(words)


def test_strings_with_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    thue = [bin(n).count("1") % 2 for n in range(300)]
    for words in (b, thue, [0] * 300, [0, 1] * 150, ([0] * 20 + [1]) * 15, []):
        assert ours(words) == brute(words)


def test_range_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 1000):
        values = rng.permutation(n)
        tree = runs.WaveletTree(values)
        left = rng.integers(0, n, 200)
        right = np.minimum(left + rng.integers(0, n + 1, 200), n)
        least = rng.integers(0, n + 2, 200)
        got = tree.successor(left, right, least, n)
        want = [min((v for v in values[a:b] if v >= x), default=n) for a, b, x in zip(left, right, least, strict=True)]
        assert got.tolist() == want


def contract(doc_id, text):
    """The whole query for one row, directly."""
    words = split(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, sha("".join(f"{s},{k},{p}\n" for s, k, p in found)), sha(collapsed(words, found)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = docs.where("length(text) < 6000").unionByName(
        frame(spark, [(n, " ".join(f"w{i % 37}" for i in range(n % 90))) for n in range(90_000, 90_400)]), allowMissingColumns=True
    )
    short = short.unionByName(frame(spark, [(None, "a b " * 9), (95_000, None), (95_001, "")]), allowMissingColumns=True)
    short.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_runs(spark, str(tmp_path))
    assert set(rows.columns) == set(COLUMNS)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in rows.collect()), key=repr)
    assert got == sorted((contract(r["doc_id"], r["text"]) for r in short.collect()), key=repr)
    assert sum(r[1] for r in got) > 50


def test_edges(spark):
    docs = edges(spark).where("coalesce(length(text), 0) < 20000")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        found = brute(split(r["text"]))
        want.append((r["doc_id"], found, collapsed(split(r["text"]), found)))
    assert got == sorted(want, key=repr)
    assert runs.find_runs(nothing(spark)).collect() == []


def test_batches_change_nothing(spark, monkeypatch):
    docs = frame(spark, [(n, "x y z " * (n % 40) + f"own {n}") for n in range(300)])
    whole = sorted(map(tuple, runs.find_runs(docs).collect()), key=repr)
    texts = [split("x y z " * (n % 40) + f"own {n}") for n in range(300)]
    assert [r[2] for r in sorted(whole)] == [collapsed(t, brute(t)) for t in texts]


def test_very_long_texts():
    started = time.time()
    for words in (["a"] * 300_000, [f"w{n}" for n in range(300_000)], ["b", "c", "b"] * 100_000):
        spans, rest = next(runs._batch([[w.encode() for w in words]], runs.LEAST))
        assert len(spans) == (0 if words[0] == "w0" else 1)
        assert len(rest.split()) == (300_000 if words[0] == "w0" else spans[0][2])
    assert time.time() - started < 90
