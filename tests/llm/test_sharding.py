from __future__ import annotations

import zlib

from rows import edges, frame, nothing, prose

from fitweave.llm.common import documents
from fitweave.llm.queries import op6_sharding
from fitweave.llm.sharding import histogram_shards


def size(text):
    return len((text or "").encode()) + 1


def check(rows, slack, shards=8):
    total, biggest = sum(size(r["text"]) for r in rows), max(size(r["text"]) for r in rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    for shard in range(shards):
        held = sum(size(r["text"]) for r in by_shard.get(shard, []))
        assert abs(held - total / shards) <= max(2 * slack * total / shards, biggest) + 1
    return by_shard


def test_whole_table(spark, sf):
    docs = documents(spark, sf)
    rows = histogram_shards(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.collect())
    check(rows, 0.001)


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    for r in op6_sharding(spark, sf).collect():
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (size(text), zlib.crc32(text.encode()), "bytes", None)


def test_equal_texts_stay_together_unless_their_group_is_huge(spark):
    docs = frame(spark, [(n, f"text {n // 7}" * 5) for n in range(3000)])
    by_text = {}
    for r in histogram_shards(docs, tolerance=0.02).collect():
        by_text.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())


def test_hot_group_is_cut(spark):
    docs = frame(spark, [(n, "copy of one text" if n % 3 else prose(n, 4)) for n in range(4000)])
    by_shard = check(histogram_shards(docs).collect(), 0.001)
    assert len(by_shard) == 8


def test_edges(spark):
    rows = histogram_shards(edges(spark), shards=3)
    assert rows.columns == [*(c for c in edges(spark).columns if c != "shard"), "shard", "slot"]
    rows = rows.collect()
    assert len(rows) == edges(spark).count()
    check(rows, 0.001, 3)
    assert histogram_shards(nothing(spark)).collect() == []
