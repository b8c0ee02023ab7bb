"""Byte-level BPE encoding and decoding in linear time.

A text is split by the vocabulary's pattern, and each piece is encoded on its own.  The bytes of a piece,
read as Latin-1, go once through an Aho-Corasick automaton of all tokens, which gives the longest token
that starts at each byte.  Encoding then walks from left to right: it takes the longest token that is
compatible with the token before it, tries shorter ones, and steps back where none is.  Two tokens are
compatible if merging their joined bytes by rank yields just these two; a sequence whose neighbours are
all compatible is the one that the merges produce.  Places found to be dead ends are marked, so each is
left at most once, and compatibilities are memoised.  Decoding joins the bytes of the tokens.

Encoded pieces and compatibilities are kept per Python worker in tables of bounded size; long texts
are split and encoded slice by slice, cut where white space begins, which is always a border of pieces.

Defined cases
* null text counts as the empty text; it has no ids, and no ids decode to the empty text
* null ``doc_id`` is carried through; repeated rows and ties each get their own row
* very long texts: memory is the text, its ids and one slice; a piece of any length takes linear time
* an empty table gives an empty result; ``encode`` ignores extra columns, ``decode`` keeps them
* ids that the vocabulary does not have raise when they are decoded
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitweave.llm.common import blank_null
from fitweave.llm.packing import default_ranks

SLICE = 1 << 20  # characters split at a time
KEPT_PIECES, KEPT_PIECE_CHARS = 300_000, 64
KEPT_PAIRS = 1_000_000
BATCH_BYTES = 8 << 20  # of results in one Arrow batch
_BORDER = regex.compile(r"(?<=\S)\s")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """Tokens with their ranks, which are their ids; every single byte is one of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        # a token that its own bytes do not merge to stands only for a piece equal to it
        made = [r for t, r in ranks.items() if len(t) == 1 or self.merged(t) == [r]]
        self.length = [len(t or b"") for t in self.bytes]
        self.shorter = [-1] * self.size
        self.automaton = ahocorasick.Automaton()
        usable = {self.bytes[r] for r in made}
        for rank in made:
            token = self.bytes[rank]
            self.automaton.add_word(token.decode("latin-1"), rank)
            prefix = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in usable), None)
            if prefix is not None:
                self.shorter[rank] = ranks[prefix]
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids by the definition: the adjacent pair of the lowest rank merges, the leftmost first."""
        rank, none = self.ids.get, self.size
        parts = [piece[n : n + 1] for n in range(len(piece))]
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            lowest = min(ranks)
            if lowest == none:
                break
            at = ranks.index(lowest)
            joined = parts[at] + parts[at + 1]
            parts[at : at + 2] = [joined]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + joined, none)
            if at < len(ranks):
                ranks[at] = rank(joined + parts[at + 1], none)
        return [self.ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        length, shorter, compatible = self.length, self.shorter, self.compatible
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends ascend, so the longest comes last
        dead = bytearray(len(piece) + 1)
        path: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not dead[end] and (not path or compatible(path[-1], token)):
                path.append(token)
                if end == len(piece):
                    return path
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = path.pop()
                at -= length[token]


class _Pieces(dict):
    """Pieces to their ids, packed; filled on first use.  A full table becomes the older one of two."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or pack_ids(self.vocabulary.encode_piece(piece.encode()))
        if len(piece) <= KEPT_PIECE_CHARS:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if packed.itemsize != 4:
        raise RuntimeError("array('I') is not 32 bits wide here")
    if not _LITTLE:
        packed.byteswap()
    return packed.tobytes()


def unpack_ids(packed: bytes) -> array:
    ids = array("I", packed)
    if not _LITTLE:
        ids.byteswap()
    return ids


_LITTLE = array("H", [1]).tobytes() == b"\x01\x00"


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices of about ``size`` characters that end where a piece ends."""
    at = 0
    while len(text) - at > size:
        border = _BORDER.search(text, at + size)
        if border is None:
            break
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(vocabulary)

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        lookup = self.pieces.__getitem__
        return b"".join(b"".join(map(lookup, self.split(part))) for part in slices(text))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, unpack_ids(packed)))


@lru_cache(maxsize=2)
def load_encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Encoder(Vocabulary(ranks), pattern)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ``ids``: the token ids of each text, as little-endian unsigned 32-bit integers in one binary value."""
    path, split = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, split)
        for batch in batches:
            yield from _mapped(batch, batch.column("text"), "ids", lambda text: encoder.encode(text.as_py()), ["doc_id"])

    rows = docs.select("doc_id", blank_null().alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("ids", T.BinaryType())]))


def decode(tokens: DataFrame, ids: str = "ids", name: str = "decoded", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows of ``tokens`` with one more column: the bytes that their packed ids stand for (null ids: none)."""
    path, split = ranks_path or default_ranks(), pattern or default_pattern()
    kept = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, split)
        for batch in batches:
            yield from _mapped(batch, batch.column(ids), name, lambda packed: encoder.decode(packed.as_py() or b""), kept)

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(name, T.BinaryType())]))


def _mapped(batch: pa.RecordBatch, values: pa.Array, name: str, change, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns ``kept`` of a batch and the changed values, in batches of bounded size."""
    done: list[bytes] = []
    first = size = 0
    for at, value in enumerate(values):
        done.append(change(value))
        size += len(done[-1])
        if size >= BATCH_BYTES or at + 1 == len(values):
            part = batch.slice(first, len(done))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(done, pa.binary())], [*kept, name])
            first, done, size = at + 1, [], 0


def n_tokens(ids: str = "ids"):
    """Number of ids in a packed column."""
    return (F.octet_length(ids) / 4).cast("long")
