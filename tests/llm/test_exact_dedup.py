from __future__ import annotations

import hashlib
import re

from rows import edges, frame, nothing

from fitweave.llm import exact_dedup as exact
from fitweave.llm.common import documents
from fitweave.llm.exact_dedup import exact_dedup, exact_groups


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for ids in groups.values():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids)) for i in ids]
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_groups(df, **options).collect()), key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_edges(spark):
    assert found(edges(spark)) == expected(pairs(edges(spark)))
    assert found(nothing(spark)) == []


def test_digests_of_every_row(spark):
    odd = frame(spark, [(1, "ab" * 200), (1, "ab" * 199 + "ba"), (2, "ab" * 200), (None, "x"), (None, "x"), (3, None)])
    for docs in (edges(spark).select("doc_id", "text"), odd):
        rows = exact.digested_groups(docs).collect()
        digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        assert sorted(((r["doc_id"], r["text_sha256"]) for r in rows), key=repr) == sorted(((i, digest(t)) for i, t in pairs(docs)), key=repr)
    assert exact.digested_groups(nothing(spark)).collect() == []


def test_whole_table(spark, sf):
    docs = documents(spark, sf)
    assert found(docs) == expected(pairs(docs))


def test_texts_that_share_length_and_prefix(spark):
    docs = frame(spark, [(n, "same start " * 3 + ("ab" if n % 3 else "ba")) for n in range(60)])
    assert found(docs, prefix=8) == expected(pairs(docs))


def test_hot_group(spark):
    docs = frame(spark, [(n, "copy" if n % 10 else f"own {n}") for n in range(5000)])
    assert found(docs) == expected(pairs(docs))


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 0)
    docs = edges(spark)
    assert found(docs) == expected(pairs(docs))


def test_rows_that_stay(spark):
    kept = exact_dedup(edges(spark))
    assert kept.columns == edges(spark).columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == sorted([1, 3, 4, 6, 8, 10, 11, 12], key=repr)
    assert exact_dedup(nothing(spark)).count() == 0


def test_levels_cut_what_the_next_one_reads(spark, monkeypatch):
    """One row per level: alone in its length, alone with its prefix, and a pair that needs the whole hash."""
    written = {}
    real = exact.materialize
    monkeypatch.setattr(exact, "materialize", lambda frame, name: written.setdefault(name, real(frame, name)))
    docs = frame(spark, [(1, "a text of its own length"), (2, "left12345"), (3, "right1234"), (4, "same text"), (5, "same text")])
    rows = {r["doc_id"]: r for r in exact.refined(docs, 4).collect()}
    assert rows[1]["key"] is None and rows[1]["full_hash"] is None
    assert rows[2]["key"] is not None and rows[2]["full_hash"] is None
    assert rows[4]["full_hash"] == rows[5]["full_hash"] and rows[5]["keep_id"] == 4
    assert sorted(r["doc_id"] for r in written["exact-keys"].collect()) == [2, 3, 4, 5]
    assert sorted(r["doc_id"] for r in written["exact-full"].collect()) == [4, 5]


def test_one_id_with_texts_that_part_at_different_levels(spark):
    docs = frame(spark, [(1, "short"), (1, "much longer than that"), (1, "shirt"), (2, "short"), (None, "short")])
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(((r["doc_id"], r["text_sha256"]) for r in exact.digested_groups(docs).collect()), key=repr)
    assert got == sorted(((i, digest(t)) for i, t in pairs(docs)), key=repr)
