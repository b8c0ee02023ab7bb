from __future__ import annotations

import random
import re

import pytest
import xxhash
from rows import edges, frame, nothing, prose

from fitweave.llm import simhash
from fitweave.llm.common import documents


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, distance=4):
    """Smallest member of each component by brute force; points: id -> fingerprint."""
    label = {i: i for i in points}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    items = sorted(points.items())
    for a, x in items:
        for b, y in items:
            if a < b and (x ^ y).bit_count() <= distance:
                one, two = find(a), find(b)
                label[max(one, two)] = min(one, two)
    return {i: find(i) for i in points}


def signed(value):
    return value - 2**64 if value >= 2**63 else value


@pytest.mark.parametrize("text", [None, "", "a", "A b\tc", "Ä b C d e", prose(1, 300), "x " * 5000, "a b c d e f"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_go_in_blocks(monkeypatch):
    texts = [prose(n, 60) + "\n \t" + prose(n + 1, n) for n in range(12)] + ["", " ", "a", "a b", "a b c d", "é " * 30]
    whole = [simhash.fingerprint(t) for t in texts]
    for size in (1, 7, 50):
        monkeypatch.setattr(simhash, "BLOCK_BYTES", size)
        assert [simhash.fingerprint(t) for t in texts] == whole


def test_whole_table(spark, sf):
    docs = documents(spark, sf)
    rows = simhash.near_classes(docs).collect()
    points = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: r["fp"] % 2**64 for r in rows} == points
    assert {r["doc_id"]: r["component_id"] for r in rows} == classes(points)


@pytest.mark.parametrize("seed", [0, 1])
def test_links_of_random_fingerprints(spark, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    points = set(centres)
    for centre in centres:
        for _ in range(40):
            value = centre
            for bit in rng.sample(range(64), rng.randrange(1, 8)):
                value ^= 1 << bit
            points.add(value)
    points = sorted(signed(p) for p in points)
    truth = sorted((a, b) for a in points for b in points if a < b and ((a ^ b) % 2**64).bit_count() <= 4)
    found = simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"))
    assert sorted((r["a"], r["b"]) for r in found.collect()) == truth
    edges_ = spark.createDataFrame(truth, "a long, b long")
    roots = {r["fp"]: r["root"] for r in simhash.components(edges_).collect()}
    linked = {p for pair in truth for p in pair}
    label = classes({p: p % 2**64 for p in points})
    assert roots == {p: label[p] for p in linked}


@pytest.mark.parametrize("distance", [0, 1, 5, 6, 8, 13])
def test_links_of_any_distance(spark, distance):
    assert simhash.segments(4) == [(0, 22), (22, 21), (43, 21)]
    rng = random.Random(distance)
    points = {0}
    for _ in range(150):
        value = rng.choice(sorted(points)) if rng.random() < 0.8 else rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randrange(1, 16)):
            value ^= 1 << bit
        points.add(value)
    points = sorted(map(signed, points))
    truth = sorted((a, b) for a in points for b in points if a < b and ((a ^ b) % 2**64).bit_count() <= distance)
    found = simhash.links(spark.createDataFrame([(p,) for p in points], "fp long"), distance)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == truth


def test_long_chain(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(300)], "a long, b long")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


def test_edges(spark):
    rows = simhash.near_classes(edges(spark)).collect()
    assert len(rows) == edges(spark).count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by_id[1] == by_id[2] == by_id[3] == {1}
    assert by_id[5] == by_id[4] == {4}
    assert by_id[9] == {8}
    assert by_id[None] == {10, 1}
    assert simhash.near_classes(nothing(spark)).collect() == []
    kept = simhash.near_dedup(edges(spark))
    assert kept.columns == edges(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 4, 6, 8, 10, 11, 12}


def test_copies_do_not_multiply(spark):
    docs = frame(spark, [(n, "the same four or five words" if n % 5 else prose(n, 50)) for n in range(4000)])
    rows = simhash.near_classes(docs).collect()
    assert len(rows) == 4000
    assert {r["component_id"] for r in rows if r["doc_id"] % 5} == {1}


def plain_words(text):
    return [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def plain_set(text):
    """Five-word shingles as the rule says."""
    words = plain_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(texts, similarity=0.8):
    """All pairs of ids with that Jaccard similarity, by shared shingles of all pairs."""
    sets, places, shared = {i: plain_set(t) for i, t in texts.items()}, {}, {}
    for i in sorted(sets):
        for s in sets[i]:
            for other in places.setdefault(s, []):
                shared[other, i] = shared.get((other, i), 0) + 1
            places[s].append(i)
    return [(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= similarity]


def near_rule(texts):
    """Smallest id of each class: fingerprints of five-word shingles within 4 bits, or the similarity."""
    label = classes({i: simhash.fingerprint(t, 5) for i, t in texts.items()})
    edges = alike(texts)
    while True:
        changed = False
        for a, b in edges:
            low, high = sorted((label[a], label[b]))
            if low != high:
                label = {i: low if r == high else r for i, r in label.items()}
                changed = True
        if not changed:
            return label


def variants(groups, copies, seed):
    """Texts in groups; copies have some words replaced, so that similarities spread around the bound."""
    rng, rows = random.Random(seed), {}
    passage = prose(seed, 60)  # in many texts, and no reason to link them
    for g in range(groups):
        words = (prose(1000 * seed + g, rng.randrange(60, 200)) + (" " + passage if g % 2 else "")).split()
        for c in range(copies):
            new = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 18)) if c else 0):
                new[rng.randrange(len(new))] = f"edit{rng.randrange(10**6)}"
            rows[len(rows)] = " ".join(new)
    return rows


@pytest.mark.parametrize("group", [simhash.GROUP, 3])
def test_similar_texts_link(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    texts = variants(25, 5, 2) | {1000: None, 1001: "", 1002: "one two", 1003: "one  two", 1004: "One two three four five six"}
    found = simhash.near_classes(frame(spark, texts.items()), 4, 5, 0.8).collect()
    got, want = {r["doc_id"]: r["component_id"] for r in found}, near_rule(texts)
    linked = [(a, b) for a, b in alike(texts)]
    assert len(linked) > 60
    recall = sum(got[a] == got[b] for a, b in linked) / len(linked)
    if group == simhash.GROUP and group > 3:
        assert got == want
    assert recall >= 0.98 and all(want[i] == want[r] for i, r in got.items())


def edited(words, rng, count):
    new = list(words)
    for at in rng.sample(range(len(new)), count):
        new[at] = f"edit{rng.randrange(10**9)}"
    return " ".join(new)


@pytest.mark.parametrize("cell", [1024, 4])
def test_pairs_whose_groups_have_other_first_sets(spark, monkeypatch, cell):
    """Two near copies share every key with many earlier texts, none of which is near to them."""
    monkeypatch.setattr(simhash, "CELL", cell, raising=False)
    monkeypatch.setattr(simhash, "GROUP", 4)
    rng, texts, near = random.Random(3), {}, []
    for base in range(5):
        words = prose(700 + base, 200).split()
        for _ in range(100):
            texts[len(texts)] = edited(words, rng, 12)
        near.append((len(texts), len(texts) + 1))
        for _ in range(2):
            texts[len(texts)] = edited(words, rng, 2)
    assert set(near) <= set(alike(texts))
    rows = simhash.near_classes(frame(spark, texts.items()), 4, 5, 0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == near_rule(texts)


def own_edits(copies, seed):
    """Copies of one text with words of their own: up to three leave them alike, more make them texts by themselves."""
    rng, words = random.Random(seed), prose(seed, 150).split()
    return {n: edited(words, rng, n % 7) for n in range(copies)}


def test_candidates_grow_with_a_large_group(spark, monkeypatch):
    """Texts beside the main class of a large group are not compared with all of it."""
    verified, counts = simhash._verified, []

    def counted(docs, alike, shingle, similarity):
        counts[-1] += alike.count()
        return verified(docs, alike, shingle, similarity)

    monkeypatch.setattr(simhash, "_verified", counted)
    monkeypatch.setattr(simhash, "GROUP", 8)
    for copies in (140, 420):
        texts = own_edits(copies, 5)
        counts.append(0)
        rows = simhash.near_classes(frame(spark, texts.items()), 4, 5, 0.8).collect()
        assert {r["doc_id"]: r["component_id"] for r in rows} == near_rule(texts)
    assert counts[1] < 4 * counts[0]


@pytest.mark.parametrize("group", [0, 4, 1000])
@pytest.mark.parametrize("cell", [1024, 4])
def test_no_alike_pair_of_a_large_group_is_ruled_out(spark, monkeypatch, group, cell):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "CELL", cell)
    rng, texts = random.Random(group), {}
    for base in range(3):
        words = prose(800 + base, 60).split()
        pool = [(rng.randrange(60), f"edit{n}") for n in range(8)]  # edits that several texts share
        for _ in range(40):
            new = list(words)
            for place, word in rng.sample(pool, rng.randrange(0, 4)):
                new[place] = word
            for _ in range(rng.randrange(0, 2)):
                new[rng.randrange(60)] = f"edit{rng.randrange(10**9)}"
            texts[len(texts)] = " ".join(new[: rng.choice([60, 60, 58, 54, 51, 49])])
    sets = {n: simhash.shingle_set(t) for n, t in texts.items()}
    lows = {n: set(s[:16].tolist()) for n, s in sets.items()}
    rest = spark.createDataFrame(
        [(n, n, len(s), [k >> 33 for k in s[:16].tolist()], k) for n, s in sets.items() for k in s[:16].view("int64").tolist()],
        "doc_id long, fp long, n long, low array<int>, key long",
    )
    unlabelled = spark.createDataFrame([], "fp long, root long")
    found = simhash._between_classes(frame(spark, texts.items()), rest, unlabelled, 5, 0.8).collect()
    pairs = {tuple(sorted((r["x"]["doc_id"], r["y"]["doc_id"]))) for r in found}
    truth = {(a, b) for a, b in alike(texts) if lows[a] & lows[b]}
    assert len(truth) > 100
    assert truth <= pairs


def test_one_large_group_of_near_copies(spark):
    texts = variants(1, 300, 4)
    rows = simhash.near_classes(frame(spark, texts.items()), 4, 5, 0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == near_rule(texts)


def test_shingle_sets_in_blocks(monkeypatch):
    texts = [prose(n, 60) + "\n \t" + prose(n + 1, n) for n in range(8)] + ["", " ", "a", "a b c d e", "a b c d e f"]
    whole = [simhash.shingle_set(t).tolist() for t in texts]
    assert [len(x) for x in whole] == [len(plain_set(t)) for t in texts]
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 7)
    assert [simhash.shingle_set(t).tolist() for t in texts] == whole
