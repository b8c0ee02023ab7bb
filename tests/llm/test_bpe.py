from __future__ import annotations

import base64
import hashlib
import time
from functools import lru_cache

import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import edges, frame, nothing

from fitweave.llm import bpe, queries
from fitweave.llm.packing import default_ranks


@lru_cache
def library():
    with open(default_ranks(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def reference():
    return library()


@pytest.fixture(scope="module")
def encoder():
    return bpe.load_encoder(default_ranks(), bpe.default_pattern())


def test_whole_table_against_the_library(spark, sf, reference):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="aabethns '\n\t1é中\U0001f600", max_size=200), st.text(alphabet="ab ", max_size=300)))
def test_any_text(text):
    encoder = bpe.load_encoder(default_ranks(), bpe.default_pattern())
    packed = encoder.encode(text)
    assert list(bpe.unpack_ids(packed)) == library().encode_ordinary(text)
    assert encoder.decode(packed) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=25), st.text(alphabet="abc", min_size=1, max_size=60))
def test_any_vocabulary(tokens, piece):
    """Also with tokens that their own bytes do not merge to."""
    ranks = {bytes([n]): n for n in range(256)}
    for token in tokens:
        ranks.setdefault(token, len(ranks))
    vocabulary = bpe.Vocabulary(ranks)
    whole = ranks.get(piece.encode())
    assert vocabulary.encode_piece(piece.encode()) == ([whole] if whole is not None else vocabulary.merged(piece.encode()))


def test_every_token_stands_for_itself(encoder):
    for token, rank in encoder.vocabulary.ids.items():
        assert encoder.vocabulary.encode_piece(token) == [rank]


def test_slices_change_nothing(encoder, reference, monkeypatch):
    text = "one two\n\n  three  \t four'll 12345 " * 300 + "x" * 500 + " " * 300 + "end"
    for size in (1, 7, 100, 5000):
        parts = list(bpe.slices(text, size))
        assert "".join(parts) == text
        assert [i for p in parts for i in reference.encode_ordinary(p)] == reference.encode_ordinary(text)


def test_very_long_pieces_take_linear_time(encoder):
    for unit in ("a", "ab", "é", " ", "\n \n", "\U0001f600"):
        started = time.time()
        packed = encoder.encode(unit * 400_000)
        assert time.time() - started < 20
        assert encoder.decode(packed) == (unit * 400_000).encode()


def test_full_tables_start_anew(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    loaded = bpe.load_encoder(default_ranks(), bpe.default_pattern())
    small = bpe.Encoder(loaded.vocabulary, bpe.default_pattern())
    text = " ".join(f"word{n % 9} thing{n}" for n in range(300))
    assert list(bpe.unpack_ids(small.encode(text))) == reference.encode_ordinary(text)
    assert len(small.pieces) <= 3 and len(small.pieces.older) <= 3


def test_edges(spark, reference):
    docs = edges(spark)
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    coded = bpe.encode(docs)
    assert coded.columns == ["doc_id", "ids"]
    got = sorted(((r["doc_id"], list(bpe.unpack_ids(r["ids"]))) for r in coded.collect()), key=repr)
    assert got == sorted(((i, reference.encode_ordinary(t)) for i, t in texts), key=repr)
    back = bpe.decode(coded.withColumnRenamed("doc_id", "text"), name="shard")
    assert back.columns == ["text", "ids", "shard"]
    assert sorted(((r["text"], bytes(r["shard"]).decode()) for r in back.collect()), key=repr) == sorted(texts, key=repr)
    assert bpe.decode(bpe.encode(nothing(spark))).collect() == []


def test_unknown_ids_raise(spark):
    bad = frame(spark, [(1, "x")]).selectExpr("doc_id", "unhex('ffffffff') AS ids")
    with pytest.raises(Exception, match="IndexError"):
        bpe.decode(bad).collect()
