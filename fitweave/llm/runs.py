"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q that is at least ``least`` and 2q words long and that
no neighbouring word extends.  The words of many texts, each closed by a mark of its own, form one
sequence.  Its suffix array comes from prefix doubling, whose ranks name every block of 2^k words, and a
wavelet tree over it answers range successor queries: the next place at or after x at which a block occurs.

For each k, blocks of B = 2^k words start at every multiple of B/2.  A run of period p between
3B/2 - 1 and 3B - 2 (from 1 for B = 4) holds such a block together with its occurrence p words later, so
the occurrences in the neighbouring window are asked for.  Those at most B/2 apart form progressions,
whose difference d is the period of the block, and only their first two terms are asked for:

* block and progression in one stretch of period d: d is the candidate period
* in two stretches that meet or overlap: every term of the progression is a candidate
* else a run over both has to map the ends or the starts of the stretches onto each other: two candidates

Single occurrences are candidates as they are.  Each candidate is extended both ways over the names of
blocks, and of equal stretches the smallest period stays.  All steps are numpy operations over the
whole batch of texts; time and memory grow with n log n.

Defined cases
* null and empty texts have no words and no runs
* null ``doc_id`` is carried through; repeated rows and ties each get their own row
* very long texts: one text is one batch and needs about 250 bytes a word
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fitweave.llm.common import blank_null

LEAST = 12
BATCH_WORDS = 1 << 16
RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


class WaveletTree:
    """Range successor over an array of the numbers below its length, level by level from the top bit.

    Bits are packed 64 to a word, with the ones before each word counted.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(int(n - 1).bit_length(), 1)
        self.words: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for bit in range(self.bits - 1, -1, -1):
            high = (values >> bit & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            as_bytes = np.packbits(high, bitorder="little")
            packed[: len(as_bytes)] = as_bytes
            words = packed.view("<u8")
            ones = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words[:-1]), out=ones[1:])
            self.words.append(words)
            self.ones.append(ones)
            self.zeros.append(n - int(high.sum()))
            values = np.concatenate([values[~high], values[high]])

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before ``at``."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def below(self, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers in slots [left, right) are smaller than ``value``."""
        count = np.zeros(len(left), np.int64)
        for level in range(self.bits):
            high = (value >> (self.bits - 1 - level) & 1).astype(bool)
            ones_left, ones_right = self._rank(level, left), self._rank(level, right)
            count += np.where(high, (right - left) - (ones_right - ones_left), 0)
            left = np.where(high, self.zeros[level] + ones_left, left - ones_left)
            right = np.where(high, self.zeros[level] + ones_right, right - ones_right)
        return count

    def smallest(self, left: np.ndarray, right: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The number with ``nth`` smaller ones in slots [left, right)."""
        value = np.zeros(len(left), np.int64)
        for level in range(self.bits):
            ones_left, ones_right = self._rank(level, left), self._rank(level, right)
            low = (right - left) - (ones_right - ones_left)
            high = nth >= low
            nth = np.where(high, nth - low, nth)
            left = np.where(high, self.zeros[level] + ones_left, left - ones_left)
            right = np.where(high, self.zeros[level] + ones_right, right - ones_right)
            value = value << 1 | high
        return value

    def successor(self, left: np.ndarray, right: np.ndarray, value: np.ndarray, none: int) -> np.ndarray:
        """The smallest number in slots [left, right) that is at least ``value``, else ``none``."""
        out = np.full(len(left), none, np.int64)
        inside = np.flatnonzero(value < none)
        left, right, value = left[inside], right[inside], value[inside]
        smaller = self.below(left, right, value)
        more = smaller < right - left
        out[inside[more]] = self.smallest(left[more], right[more], smaller[more])
        return out


class Suffixes:
    """Suffix array of a sequence, names of its blocks of 2^k words, and common extensions."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = words[order[1:]] != words[order[:-1]]
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = np.empty(n, np.int32)
        rank[order] = first
        self.names = [rank]
        slots, span = np.arange(n), 1
        while True:
            closing = np.ones(len(slots), bool)
            closing[:-1] = fresh[1:]
            shared = ~(fresh & closing)
            slots, first = slots[shared], first[shared]
            if not len(slots):
                break
            places = order[slots]
            after = places + span
            second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
            key = first * (n + 1) + second + 1
            by_key = np.argsort(key, kind="stable")
            key = key[by_key]
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            first = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
            places = places[by_key]
            order[slots] = places
            rank = rank.copy()
            rank[places] = first
            self.names.append(rank)
            span *= 2
        self.order = order

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that starts at ``a`` and at ``b``."""
        start = a
        for k in range(len(self.names) - 2, -1, -1):
            step = (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
            a, b = a + step, b + step
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before ``a`` and before ``b`` (a < b)."""
        end = a
        for k in range(len(self.names) - 2, -1, -1):
            from_a, from_b = a - (1 << k), b - (1 << k)
            inside = from_a >= 0
            same = self.names[k][np.maximum(from_a, 0)] == self.names[k][np.maximum(from_b, 0)]
            step = (inside & same).astype(np.int64) << k
            a, b = a - step, b - step
        return end - a


def candidates(text: Suffixes, tree: WaveletTree) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and candidate periods; every run has a block with its smallest period among them."""
    n = len(text.order)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(2, len(text.names) - 1):
        block, names = 1 << k, text.names[k]
        least, most = (1 if k == 2 else 3 * block // 2 - 1), 3 * block - 2
        sizes = np.bincount(names, minlength=n)
        start = np.arange(0, n - block + 1, block // 2)
        start = start[sizes[names[start]] > 1]
        left = names[start].astype(np.int64)
        right = left + sizes[left]
        place = tree.successor(left, right, start + least, n)
        while len(start):
            near = (place < n) & (place <= start + most)
            start, left, right, place = start[near], left[near], right[near], place[near]
            following = tree.successor(left, right, place + 1, n)
            gap = following - place
            chained = (following < n) & (gap <= block // 2)
            found.append((start[~chained], (place - start)[~chained]))
            resume = following.copy()
            if chained.any():
                s, t, d = start[chained], place[chained], gap[chained]
                here = s - text.backward(s, s + d), s + d + text.forward(s, s + d)
                there = t - text.backward(t, t + d), t + d + text.forward(t, t + d)
                one = here[0] == there[0]
                found.append((s[one], d[one]))
                meeting = ~one & (here[1] >= there[0])
                terms = (np.minimum(there[1] - block, s + most) - t)[meeting] // d[meeting] + 1
                nth = np.arange(terms.sum()) - np.repeat(np.cumsum(terms) - terms, terms)
                found.append((np.repeat(s[meeting], terms), np.repeat((t - s)[meeting], terms) + nth * np.repeat(d[meeting], terms)))
                apart = ~one & ~meeting
                for side in (0, 1):
                    found.append((s[apart], (there[side] - here[side])[apart]))
                resume[chained] = tree.successor(left[chained], right[chained], there[1] - block + 1, n)
            place = resume
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, periods = (np.concatenate(part) for part in zip(*found, strict=True))
    valid = (periods > 0) & (starts + periods < n)
    keys = np.unique(starts[valid] * n + periods[valid])
    return keys // n, keys % n


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence whose last word is unique, by start, then period."""
    text = Suffixes(words)
    starts, periods = candidates(text, WaveletTree(text.order))
    begin = starts - text.backward(starts, starts + periods)
    end = starts + periods + text.forward(starts, starts + periods)
    good = end - begin >= np.maximum(least, 2 * periods)
    rows = np.stack([begin[good], end[good], periods[good]], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[smallest]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _batch(texts: list[list[bytes]], least: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Runs (start, length, period) and kept words of each text."""
    numbers: dict[bytes, int] = {}
    flat: list[int] = []
    for words in texts:
        flat.extend([numbers.setdefault(w, len(numbers)) for w in words])
        flat.append(-1)
    sequence = np.array(flat, np.int64)
    marks = np.flatnonzero(sequence < 0)
    sequence[marks] = len(numbers) + np.arange(len(marks))
    found = runs_of(sequence, least)
    opening = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(opening, found[:, 0] + found[:, 2], 1)
    np.add.at(opening, found[:, 1], -1)
    kept = np.cumsum(opening) == 0
    bases = np.concatenate([[0], marks[:-1] + 1])
    borders = np.searchsorted(found[:, 0], [*bases, len(sequence)])
    for n, words in enumerate(texts):
        rows = found[borders[n] : borders[n + 1]]
        spans = np.stack([rows[:, 0] - bases[n], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
        stay = compress(words, kept[bases[n] : marks[n]].tolist()) if len(rows) else words
        yield spans, b" ".join(stay)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``runs`` by start, then period, and ``collapsed``.

    Words are maximal stretches without U+0020 and U+0009 to U+000D, numbered from 0.  ``collapsed`` has
    the words that no run holds after its first period, joined by one space.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def results(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        spans, collapsed = zip(*_batch(texts, least), strict=True)
        rows = np.concatenate(spans)
        offsets = np.cumsum([0, *map(len, spans)])
        lists = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()),
            pa.StructArray.from_arrays([pa.array(rows[:, c], pa.int64()) for c in range(3)], ["start", "length", "period"]),
        )
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), lists.cast(kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
            ["doc_id", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for at, text in enumerate(batch.column("text")):
                texts.append(text.as_buffer().to_pybytes().split() if text.is_valid else [])
                ids.append(batch.column("doc_id").slice(at, 1))
                size += len(texts[-1]) + 1
                if size >= BATCH_WORDS:
                    yield results(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield results(ids, texts)

    rows = docs.select("doc_id", blank_null().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RUNS}")
