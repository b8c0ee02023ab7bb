from __future__ import annotations

import random
import re

import numpy as np
import pytest
from rows import edges, nothing, prose

from fitweave.llm import decontam
from fitweave.llm.common import documents

ITEMS = "item_id long, text string"


def plain_normal(text):
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def best_edits(item, text):
    """Fewest edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def spoil(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcxyz")
        elif kind == 1 and len(chars) > 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("abcxyz"))
    return "".join(chars)


def search(text, items):
    codes, places = decontam.normalise(text)
    return [(items.ids[n], places[s], places[e - 1] + 1, k) for n, s, e, k in decontam.search(codes, items)]


@pytest.mark.parametrize("seed", range(6))
def test_every_match_within_the_budget_is_found(seed):
    rng = random.Random(seed)
    texts = {n: prose(seed * 100 + n, rng.randrange(2, 25)) for n in range(12)}
    items = decontam.index_items(list(texts.items()))
    for n, text in texts.items():
        normal = plain_normal(text)
        number = items.ids.index(n)
        budget = int(items.budget[number])
        assert budget <= 0.1 * len(normal)
        for edits in {0, 1, budget // 2, budget, budget + 1, budget + 6}:
            doc = f"{prose(n + 500, rng.randrange(0, 30))} {spoil(normal, edits, rng)} {prose(n + 900, rng.randrange(0, 30))}"
            truth = best_edits(normal, plain_normal(doc))
            found = [k for i, _, _, k in search(doc, items) if i == n]
            assert (min(found) if found else None) == (truth if truth <= budget else None)


def test_alignment_gives_the_place():
    item = np.frombuffer("abcdefghij".encode("utf-32-le"), np.uint32)
    region = np.frombuffer("xxabcdXfghijyy".encode("utf-32-le"), np.uint32)
    assert decontam.align(item, region, 0, 4, 2) == (1, 2, 12)
    assert decontam.align(item, region, 0, 4, 0) is None


def test_normalise_keeps_places():
    text = "  Àb--İc\n ÉD_e "
    codes, places = decontam.normalise(text)
    assert "".join(map(chr, codes)) == "àb İc éd e"
    assert [text[p].lower() for p in places if text[p].isalnum()] == [c for c in "àb" + "İ".lower() + "céde"] or len(codes) == len(places)


def test_whole_table(spark, sf):
    docs, bench = documents(spark, sf), documents(spark, sf, "benchmark")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    texts = {r["doc_id"]: plain_normal(r["text"] or "") for r in docs.collect()}
    items = {r["item_id"]: plain_normal(r["text"]) for r in bench.collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= found
    budget = {i: len(x) // 10 for i, x in items.items()}
    assert all(items[i] in texts[d] or best_edits(items[i], texts[d]) <= budget[i] for d, i in found)


def test_spans_and_blocks(spark, monkeypatch):
    items = [(n, prose(n, 20)) for n in range(30)]
    docs = [(n, f"Öh, {prose(n + 99, 30)}\n\n{items[n][1].upper()}!! tail") for n in range(30)] + [(99, prose(7777, 200))]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, ITEMS)
    rows = decontam.find_leaks(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in rows) == [(n, n, 0) for n in range(30)]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(plain_normal(texts[r["doc_id"]][r["start"] : r["end"]]) == plain_normal(items[r["item_id"]][1]) for r in rows)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    assert sorted(decontam.find_leaks(docs, bench).collect()) == sorted(rows)


def test_long_text_in_pieces(monkeypatch):
    item = prose(3, 20)
    items = decontam.index_items([(1, item)])
    text = prose(4, 800) + " " + item + " " + prose(5, 800) + " " + item
    whole = search(text, items)
    assert len(whole) == 2
    monkeypatch.setattr(decontam, "PIECE", 101)
    assert search(text, items) == whole


def test_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "tiny"), (4, prose(1, 80)), (None, prose(1, 80)), (4, prose(1, 80))], ITEMS)
    found = decontam.find_leaks(edges(spark), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(10, 4), (10, None), (None, 4), (None, None)}
    kept = decontam.decontaminate(edges(spark), bench)
    assert kept.columns == edges(spark).columns
    assert kept.count() == edges(spark).where("doc_id <> 10").count()
    empty = spark.createDataFrame([], ITEMS)
    assert decontam.find_leaks(edges(spark), empty).collect() == []
    assert decontam.find_leaks(nothing(spark), bench).collect() == []
    assert decontam.decontaminate(edges(spark), empty).count() == edges(spark).count()
