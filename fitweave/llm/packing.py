"""Best-fit-decreasing packing of token pieces into sequences.

Which bin takes a piece depends on piece lengths only, and lengths are whole numbers up to the
capacity.  So the packing itself works on the histogram of lengths: from the longest length down, a
segment tree over remaining capacities names the tightest open bins that still fit, in logarithmic
time, and a run of equal pieces fills a run of equal bins in one step.  The outcome is best-fit
decreasing over all pieces of the corpus, not of one partition.  The driver holds the histogram and the
list of steps, both bounded by the capacity and not by the number of pieces.  The pieces stay in
Spark: each gets its rank among those of its length, from its rank in its task plus the counts of the
tasks before, and finds its place by looking its rank up in the steps.

Defined cases
* null text counts as empty; an empty text is one piece that holds the end id alone
* null ``doc_id`` is carried through; repeated rows are packed once per row
* texts longer than the capacity are cut into whole capacities; only their first piece may be shorter
* equal lengths are interchangeable, ties cannot change the number of sequences
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitweave.llm.common import materialize

CAPACITY = 1024
END_ID = 2
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, chunk_rank long"


def default_ranks() -> str:
    """Merge ranks of the public byte-level vocabulary ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoding(ranks_path: str):
    """Encoder with the vocabulary, pattern and special token of ``byte_bpe_50k.json``; same ids, less CPU."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, with the task that made them and their rank among its pieces of that length."""
    path = ranks_path or default_ranks()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(path)
        special = set(SPECIAL)
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows: list[tuple] = []
                kept = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.append(encoding.encode_to_numpy(text or "", allowed_special=special, disallowed_special=()), [end_id]).astype("<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        part = ids[start : start + length]
                        rows.append((doc_id, piece, start, length, zlib.crc32(part.tobytes()), chunk, seen[length]))
                        seen[length] += 1
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "chunk_rank"]
                    if keep_ids:
                        arrays.append(pa.array(kept, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenise, schema)


class CapacityTree:
    """Segment tree over remaining capacities; finds the tightest open one in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)

    def set(self, capacity: int, bins: bool) -> None:
        at = self.leaves + capacity
        self.open[at] = int(bins)
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest open capacity that is at least ``need``."""
        at = self.leaves + need
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


@dataclass(frozen=True)
class Step:
    """Pieces of one length, from ``rank`` on, ``each`` to every one of ``bins`` bins from ``first_bin`` on."""

    length: int
    rank: int
    each: int
    bins: int
    first_bin: int
    offset: int


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Step], int]:
    """Best-fit decreasing over a histogram of lengths: the steps and the number of bins."""
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs of bins (first, number)
    steps: list[Step] = []
    bins = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, number = capacity, bins, -(-left // (capacity // length))
                bins += number
            else:
                first, number = runs[room].pop()
            each = room // length
            whole = min(number, left // each)
            if not whole:
                each, whole = left, 1
            steps.append(Step(length, rank, each, whole, first, capacity - room))
            rank, left = rank + each * whole, left - each * whole
            for rest, start, n in ((room - each * length, first, whole), (room, first + whole, number - whole)):
                if n:
                    runs.setdefault(rest, []).append((start, n))
                    tree.set(rest, True)
            if not runs.get(room):
                tree.set(room, False)
    return steps, bins


def _lookup(steps: list[Step]):
    """A function that finds sequence and offset for arrays of lengths and ranks."""
    rows = np.array([(s.length, s.rank, s.each, s.first_bin, s.offset) for s in steps], np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (rows[:, 0] << 48) + rows[:, 1]

    def place(lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = rows[np.searchsorted(keys, (lengths << 48) + ranks, "right") - 1]
        index = ranks - step[:, 1]
        return step[:, 3] + index // step[:, 2], step[:, 4] + index % step[:, 2] * lengths

    return place


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` on request."""
    pieces = materialize(token_pieces(docs, capacity, end_id, ranks_path, keep_ids), "pieces")
    counts = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = _lookup(best_fit(histogram, capacity)[0])
    # one row per task and length here, so a window over a length holds as many rows as there were tasks
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                column = {n: batch.column(n) for n in batch.schema.names}
                rank = np.asarray(column.pop("rank"))
                column["sequence_id"], column["offset"] = map(pa.array, place(np.asarray(column["length"]), rank))
                yield pa.RecordBatch.from_pydict(column)

    ranked = pieces.join(bases, ["length", "chunk"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = dict(pieces.select(names).dtypes)
    schema = ", ".join(f"{n} {kinds[n] if n in kinds else 'bigint'}" for n in [*names, "sequence_id", "offset"])
    return ranked.select(*names, (F.col("base") + F.col("chunk_rank")).alias("rank")).mapInArrow(assign, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and its ids; needs ``pack(..., keep_ids=True)``.

    A group is one sequence, so it never holds more ids than the capacity.
    """
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
