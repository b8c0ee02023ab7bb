from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import collect, edges, frame, nothing, prose

from fitweave.llm import packing
from fitweave.llm.common import documents


def plain_best_fit(lengths, capacity):
    bins, count = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(bins, length)
        room = bins.pop(at) if at < len(bins) else capacity
        count += room == capacity and True
        if room > length:
            bisect.insort(bins, room - length)
    return count


@given(st.lists(st.integers(1, 40), max_size=200))
@settings(max_examples=150, deadline=None)
def test_histogram_packing_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    steps, bins = packing.best_fit(histogram, 40)
    assert bins == plain_best_fit(lengths, 40)
    place = packing._lookup(steps)
    used = {}
    for length, number in histogram.items():
        for seq, offset in zip(*place(np.full(number, length), np.arange(number)), strict=True):
            used.setdefault(int(seq), []).append((int(offset), length))
    assert set(used) == set(range(bins))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40


def test_tree_finds_the_tightest():
    tree, rng, open_now = packing.CapacityTree(50), random.Random(3), set()
    for _ in range(2000):
        value = rng.randrange(51)
        tree.set(value, value not in open_now)
        open_now ^= {value}
        need = rng.randrange(51)
        assert tree.tightest(need) == min((v for v in open_now if v >= need), default=None)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_same_ids_as_the_tokenizer(spark, sf):
    texts = [r["text"] for r in documents(spark, sf).select("text").collect()]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "  x  \n\n y\t", "I'll don't 's", "日本語 \U0001f600 ١٢٣", "  z"]
    encoding, reference = packing.load_encoding(packing.default_ranks()), tokenizer()
    for text in texts:
        ours = encoding.encode_to_numpy(text, allowed_special=set(packing.SPECIAL), disallowed_special=())
        assert ours.tolist() == reference.encode(text, add_special_tokens=False).ids


def check(rows, ids_of, capacity=1024):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, ids in ids_of.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert sum(p["length"] for p in pieces) == len(ids)
        assert all(p["length"] == capacity for p in pieces[1:])
        for p in pieces:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == p["ids_crc32"]
    return len(by_sequence)


def test_whole_table(spark, sf):
    docs = documents(spark, sf)
    reference = tokenizer()
    ids = {r["doc_id"]: [*reference.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = packing.pack(docs).collect()
    assert check(rows, ids) == plain_best_fit([r["length"] for r in rows], 1024)


def test_ids_round_trip(spark):
    docs = frame(spark, [(n, prose(n, 40 * n)) for n in range(1, 30)])
    packed = packing.pack(docs, capacity=64, keep_ids=True)
    rows = {(r["sequence_id"], r["offset"]): r for r in packed.collect()}
    sequences = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for (sequence, offset), r in rows.items():
        assert sequences[sequence][offset : offset + r["length"]] == r["ids"]
    assert sum(map(len, sequences.values())) == sum(r["length"] for r in rows.values())


def test_edges(spark):
    rows = packing.pack(edges(spark)).collect()
    assert collect(edges(spark).select("doc_id").distinct(), "doc_id") == sorted({(r["doc_id"],) for r in rows}, key=repr)
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert [r["length"] for r in empty] == [1, 1]
    assert sum(r["doc_id"] == 5 for r in rows) == 2
    check(rows, {})
    assert packing.pack(nothing(spark)).collect() == []


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 129])
def test_cut(n):
    pieces = packing.cut(n, 64)
    assert sum(length for _, length in pieces) == n
    assert all(length == 64 for _, length in pieces[1:])
