"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a document with at most k edits shares at least m - q + 1 - k q of
its q-grams with the region, and all of them lie on at most k + 1 neighbouring diagonals (document
position minus item position).  So for every document the q-grams it shares with the items are counted
per band of 2 (k + 1) diagonals; bands overlap by half, so each run of k + 1 diagonals lies in one band
whole.  Bands that reach the bound are verified by a banded alignment of the whole item against the
region, with free ends in the document.  Nothing within the edit budget is missed.

Items and documents are compared in lower case with each run of characters other than letters and digits
as one space.  The budget is ``rate`` of the item's characters (10 %, so 90 % of them agree), lowered where
an item is so short that the bound would reach zero.

Items are sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters and ``BLOCK_ITEMS`` items, one
pass over the documents each; documents are never shuffled.

Defined cases
* null text or item counts as empty; items with fewer than q characters after normalising match nothing
* very long texts are searched whole, in pieces of bounded memory that overlap by the longest region
* equal items (ties, repeated rows) are each reported; repeated documents give their rows again
* null ``doc_id`` is reported as null; rows of a document whose id is null are judged together
* an empty table of either kind gives no matches; extra columns are ignored by ``find_leaks`` and kept
  by ``decontaminate``
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitweave.llm.common import without_ids

Q = 8
RATE = 0.1
BLOCK_ITEMS = 4096
BLOCK_CHARS = 1 << 20
PIECE = 1 << 20  # positions of a document that are looked up at once
FACTOR = 0x9E3779B97F4A7C15
SLOT_BITS = 20


def _word_table() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x10000)])


WORDS = _word_table()


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and the place in the source that each stands for."""
    lower = text.lower()
    if len(lower) != len(text):  # a few capitals become two characters; keep places exact
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = WORDS[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first of each run of other characters
    places = np.flatnonzero(keep)
    codes = np.where(word, codes, 32)[places]
    if len(codes) and codes[0] == 32:
        codes, places = codes[1:], places[1:]
    if len(codes) and codes[-1] == 32:
        codes, places = codes[:-1], places[:-1]
    return codes, places


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram that starts at each position; q is a power of two."""
    hashes = codes.astype(np.uint64) + np.uint64(1)
    factor, width = FACTOR, 1
    while width < Q:
        hashes = hashes[:-width] * np.uint64(factor) + hashes[width:] if len(hashes) > width else hashes[:0]
        factor, width = factor * factor % 2**64 | 1, 2 * width
    return hashes


@dataclass(frozen=True)
class Items:
    """One block of items and the index of their q-grams."""

    ids: list
    codes: list[np.ndarray]
    hashes: np.ndarray  # distinct, sorted, with one more that is larger than all
    first: np.ndarray  # where the places of each hash start in the next two
    item: np.ndarray
    place: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    slots: np.ndarray


def slot(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def index_items(rows: list[tuple[object, str]], rate: float = RATE) -> Items:
    ids, codes = [], []
    for item_id, text in rows:
        code = normalise(text or "")[0]
        if len(code) >= Q:
            ids.append(item_id)
            codes.append(code)
    lengths = np.array([len(c) for c in codes], np.int64)
    budget = np.minimum((lengths * rate + 1e-9).astype(np.int64), (lengths - Q) // Q) if ids else lengths
    grams = [gram_hashes(c) for c in codes]
    hashes = np.concatenate([*grams, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(ids)), [len(g) for g in grams])
    place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
    order = np.argsort(hashes, kind="stable")
    distinct, first = np.unique(hashes[order], return_index=True)
    slots = np.zeros(1 << SLOT_BITS, bool)
    slots[slot(hashes)] = True
    first = np.append(first, len(hashes))
    distinct = np.append(distinct, np.uint64(2**64 - 1))
    return Items(ids, codes, distinct, first, item[order], place[order], budget, lengths - Q + 1 - budget * Q, slots)


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best alignment of the whole item with a part of the region, on diagonals low to high.

    (edits, start, end) in the region, or None if it takes more than ``budget`` edits.  One row of the band
    per item character; cell j of row i stands for region position i + low + j.
    """
    width = high - low + 1
    big = np.int64(len(item) + budget + 2)
    at = np.arange(width)
    first = low + at
    inside = (first >= 0) & (first <= len(region))
    cost = np.where(inside, 0, big)
    start = first.copy()
    padded = np.concatenate([region, np.zeros(1, region.dtype)])
    for i, code in enumerate(item.tolist()):
        here = first + i  # region characters used up before this row
        usable = (here >= 0) & (here < len(region))
        step = np.where(usable & (padded[np.clip(here, 0, len(region))] == code), 0, 1)
        diagonal = np.where(usable, cost + step, big)
        skip = np.append(cost[1:] + 1, big)  # the item has a character that the region lacks
        use = skip < diagonal
        new = np.where(use, skip, diagonal)
        origin = np.where(use, np.append(start[1:], 0), start)
        # characters that only the region has: best cell to the left plus the distance
        keyed = (new - at) * (width + 1) + at
        best = np.minimum.accumulate(keyed)
        source = best % (width + 1)
        cost = np.minimum(new[source] + at - source, big)
        start = origin[source]
        if cost.min() > budget:
            return None
    best = int(np.argmin(cost))
    if cost[best] > budget:
        return None
    return int(cost[best]), int(start[best]), int(low + len(item) + best)


def unchanged(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int] | None:
    """The result of ``align`` if the region holds the item without any edit."""
    whole, wanted = region.tobytes(), item.tobytes()
    at = whole.find(wanted)
    while at >= 0 and at % item.itemsize:
        at = whole.find(wanted, at + 1)
    return (0, at // item.itemsize, at // item.itemsize + len(item)) if at >= 0 else None


def search(codes: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, edits) of the best region of each item per cluster of bands."""
    if not items.ids or len(codes) < Q:
        return []
    found_place, found_gram = [], []
    for at in range(0, len(codes) - Q + 1, PIECE):
        hashes = gram_hashes(codes[at : at + PIECE + Q - 1])
        likely = np.flatnonzero(items.slots[slot(hashes)])
        hashes = hashes[likely]
        known = np.searchsorted(items.hashes[:-1], hashes)
        hit = np.flatnonzero(items.hashes[known] == hashes)
        hit = hit[known[hit] < len(items.hashes) - 1]
        if len(hit):
            known = known[hit]
            repeat = items.first[known + 1] - items.first[known]
            found_place.append(np.repeat(likely[hit] + at, repeat))
            inner = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            found_gram.append(np.repeat(items.first[known], repeat) + inner)
    if not found_place:
        return []
    place, gram = np.concatenate(found_place), np.concatenate(found_gram)
    item = items.item[gram]
    # an item needs its bound of hits somewhere; most items fall here
    enough = np.bincount(item, minlength=len(items.ids)) >= items.bound
    kept = enough[item]
    place, item, in_item = place[kept], item[kept], items.place[gram[kept]]
    if not len(place):
        return []
    half = items.budget[item] + 1
    band = (place - in_item) // half  # band b holds diagonals b * half to (b + 2) * half - 1
    every = np.stack([np.concatenate([item, item]), np.concatenate([band, band - 1]), np.concatenate([in_item, in_item])])
    shift = int(band.min()) - 1
    scale = int(band.max()) - shift + 1
    longest = max(len(c) for c in items.codes)
    keys = np.unique(((every[0] * scale + (every[1] - shift)) * longest) + every[2])  # distinct q-grams of the item
    bands, shared = np.unique(keys // longest, return_counts=True)
    out = []
    for key in bands[shared >= items.bound[bands // scale]].tolist():
        number, band_at = key // scale, key % scale + shift
        code, budget = items.codes[number], int(items.budget[number])
        low = band_at * (budget + 1)
        high = low + 2 * (budget + 1) - 1
        start = max(0, low)
        region = codes[start : max(start, high + len(code))]
        result = unchanged(code, region) or align(code, region, low - start, high - start, budget)
        if result:
            out.append((number, start + result[1], start + result[2], result[0]))
    return best_apart(out)


def best_apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping regions of one item, the one with the fewest edits, then the first."""
    out: list[tuple[int, int, int, int]] = []
    for number, start, end, edits in sorted(found):
        if out and out[-1][0] == number and start < out[-1][2]:
            if edits < out[-1][3]:
                out[-1] = (number, start, end, edits)
        else:
            out.append((number, start, end, edits))
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of bounded size, read one partition at a time."""
    block: list[tuple[object, str]] = []
    chars = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = row["text"] or ""
        if block and (len(block) == BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row["item_id"], text))
        chars += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end (code points of the document's text) and edits of every match."""
    schema = "doc_id long, item_id long, start int, end int, edits int"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = ["doc_id", "item_id", "start", "end", "edits"]
    narrow = docs.select(F.col("doc_id").cast("long"), "text")

    def scanner(block: list[tuple[object, str]]):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = index_items(block, rate)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    codes, places = normalise(text.as_py() or "")
                    rows += [
                        (doc_id, items.ids[n], int(places[s]), int(places[e - 1]) + 1, edits)
                        for n, s, e, edits in search(codes, items)
                        if e > s
                    ]
                if rows:
                    columns = zip(zip(*rows, strict=True), kinds, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names)

        return scan

    found = None
    for block in item_blocks(benchmark):
        part = narrow.mapInArrow(scanner(block), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents without any match, with all their columns."""
    leaked = find_leaks(docs, benchmark, rate)
    return without_ids(docs, leaked.select("doc_id", F.lit(False).alias("stays")))
