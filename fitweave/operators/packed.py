"""Requirements against evidence of bounded size, many at once in their own tasks.

The postings of a profile, its evidence rows per term, are a few arrays of numbers that every task holds.  A batch of
requirements looks its terms up in them and counts the pairs of requirement and evidence row that it meets, so that
neither terms nor pairs become rows of a table.  Evidence rows are numbered in the order of citations (``slot``), so rows of
one weight stand together.  They are met by falling weight: a requirement with enough relevant rows meets no lighter ones.

Memory is bounded by the postings and by ``HITS``, whatever the number of requirements.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

HITS = 1 << 18  # pairs of term and evidence row looked at together; one requirement has at most all postings
TOP = "array<struct<rank:int,evidence_id:string,context:int,relevant:boolean>>"
FLAGS = ["several_rows", "keyword_hit", "professional_alternative", "any_professional", "any_nationality",
         "any_relevant", "relevant_professional", "relevant_nationality"]
FACTS = f"struct<covered_terms:bigint,{','.join(f'{f}:boolean' for f in FLAGS)},top:{TOP}>"

# a pair's place among those of its requirement: relevant, weight, overlap, slot
_OVERLAP, _WEIGHT = 24, 48
_RELEVANT = 1 << 60
_PROFESSIONAL, _NATIONALITY = 1, 2


@dataclass
class Postings:
    """Evidence of one profile."""

    terms: pa.Array
    kinds: np.ndarray  # bits of the rows that have a term
    least: np.ndarray  # numbers of the first and last evidence id of a term
    most: np.ndarray
    weights: list[Weight]  # falling


@dataclass
class Weight:
    """Evidence of one profile and weight."""

    starts: np.ndarray  # first posting of each term, and the end
    slots: np.ndarray  # of each posting, from 0
    base: np.ndarray  # weight and place of each slot
    kinds: np.ndarray  # bits of each slot
    first: int  # slots before, of all profiles
    lighter: int  # bits of the lighter rows


@dataclass
class Evidence:
    profiles: dict[object, Postings]
    ids: pa.Array  # per slot of all profiles
    contexts: np.ndarray


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the distinct values, -1 for null, and the values."""
    coded = pc.dictionary_encode(column).combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    return pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False), coded.dictionary


def pack(rows: pa.Table) -> Evidence:
    """Rows of ``profile_id, evidence_id, evidence_code, term`` in the order of profile, citation and code."""
    profile, profiles_ = _coded(rows.column("profile_id"))
    ids, names = _coded(rows.column("evidence_id"))
    codes = rows.column("evidence_code").to_numpy().astype(np.int64)
    terms = rows.column("term").combine_chunks()

    def changes(*columns: np.ndarray) -> np.ndarray:
        changed = np.zeros(max(len(ids) - 1, 0), bool)
        for column in columns:
            changed |= column[1:] != column[:-1]
        return np.append(len(ids) > 0, changed)[: len(ids)]

    new = changes(profile, ids, codes)
    slot_of, first_rows = np.cumsum(new) - 1, np.flatnonzero(new)
    borders = np.flatnonzero(changes(profile))
    first_codes, numbers = codes[first_rows], ids[first_rows]
    contexts = first_codes // 10 % 10
    kinds = ((contexts == 1) * _PROFESSIONAL | (first_codes % 10 == 1) * _NATIONALITY).astype(np.uint8)
    profiles = {}
    for low, high in zip(borders, [*borders[1:], len(ids)]):
        if profile[low] < 0:  # null equals no profile
            continue
        term, words = _coded(pa.chunked_array([terms.slice(low, high - low)]))
        order = np.argsort(term, kind="stable")  # slots rise within a term
        slot, ends = slot_of[low:high][order], np.arange(len(words) + 1)
        starts = np.searchsorted(term[order], ends)
        number = numbers[slot]  # -1 for null
        weights, lighter = [], 0
        first, last = slot_of[low], slot_of[high - 1] + 1
        weight_of = first_codes[first:last] // 100
        for at in np.flatnonzero(np.append(weight_of[1:] != weight_of[:-1], True))[::-1] + 1:
            begin = int(np.searchsorted(-weight_of, -weight_of[at - 1])) + first
            end = int(at) + first
            mine = (slot >= begin) & (slot < end)
            place = np.arange(end - begin)
            weights.append(Weight(
                np.searchsorted(term[order][mine], ends), (slot[mine] - begin).astype(np.int32),
                (first_codes[begin:end] // 100 << _WEIGHT) + ((1 << _OVERLAP) - 1 - place), kinds[begin:end], begin, lighter,
            ))
            lighter |= int(np.bitwise_or.reduce(kinds[begin:end]))
        profiles[profiles_[profile[low]].as_py()] = Postings(
            words, np.bitwise_or.reduceat(kinds[slot], starts[:-1]),
            np.minimum.reduceat(np.where(number < 0, len(names), number), starts[:-1]),
            np.maximum.reduceat(number, starts[:-1]), weights[::-1],
        )
    return Evidence(profiles, names.cast(pa.string()).take(pa.array(numbers, mask=numbers < 0)), contexts)


def _lookup(words: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and term number of the known ones among the words of all rows."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(words)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms = pc.fill_null(pc.index_in(flat, value_set=known.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
    found = np.flatnonzero(terms >= 0)
    return np.repeat(np.arange(len(lengths)), lengths)[found], terms[found].astype(np.int64)


class _Facts:
    """Facts of the requirements of a batch, filled profile by profile."""

    def __init__(self, n: int, cited: int):
        self.covered = np.zeros(n, np.int64)
        self.flags = {name: np.zeros(n, bool) for name in FLAGS}
        self.slots = np.full((n, cited), -1, np.int64)
        self.best = np.full((n, cited), -1, np.int64)

    def meet(self, p: Postings, rows: np.ndarray, terms: pa.Array, keywords: pa.Array, anchors: pa.Array) -> None:
        """Requirements of one profile, which are the given rows of the batch."""
        counts = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        body, term = _lookup(terms, p.terms)
        self.covered[rows] = np.bincount(body, minlength=len(rows))
        pair = body * len(p.terms) + term

        def marked(words: pa.Array) -> np.ndarray:
            row, word = _lookup(words, p.terms)
            return np.isin(pair, row * len(p.terms) + word) if len(row) else np.zeros(len(pair), bool)

        keyword = marked(keywords)
        self.flags["keyword_hit"][rows[body[keyword]]] = True
        anchored = marked(anchors) & ((p.kinds[term] & _PROFESSIONAL) > 0)
        self.flags["professional_alternative"][rows[body[anchored]]] = True
        kinds = np.zeros(len(rows), np.uint8)
        if len(body):
            starts = np.flatnonzero(np.append(True, body[1:] != body[:-1]))
            met = body[starts]
            kinds[met] = np.bitwise_or.reduceat(p.kinds[term], starts)
            several = np.maximum.reduceat(p.most[term], starts) > np.minimum.reduceat(p.least[term], starts)
            self.flags["several_rows"][rows[met]] = several
        relevant_kinds = np.zeros(len(rows), np.uint8)
        for weight in p.weights:
            self._meet_weight(weight, rows, counts, relevant_kinds, body, term, keyword)
            # lighter rows are not cited, and what kinds they are of is known
            open_kinds = kinds & ~relevant_kinds & weight.lighter
            open_ = ((self.best[rows, -1] < _RELEVANT) | (open_kinds > 0))[body]
            body, term, keyword = body[open_], term[open_], keyword[open_]
        self.flags["any_relevant"][rows] = self.best[rows, 0] >= _RELEVANT
        for name, bit in (("professional", _PROFESSIONAL), ("nationality", _NATIONALITY)):
            self.flags[f"any_{name}"][rows] = (kinds & bit) > 0
            self.flags[f"relevant_{name}"][rows] = (relevant_kinds & bit) > 0

    def _meet_weight(self, w: Weight, rows, counts, relevant_kinds, body, term, keyword) -> None:
        lengths = w.starts[term + 1] - w.starts[term]
        some = lengths > 0
        body, term, keyword, lengths = body[some], term[some], keyword[some], lengths[some]
        ends = np.cumsum(lengths)
        # cut where a requirement ends
        last = np.flatnonzero(np.append(body[1:] != body[:-1], True)) + 1 if len(body) else body
        low = 0
        while low < len(body):
            before = ends[low - 1] if low else 0
            fit = int(np.searchsorted(ends[last - 1], before + HITS, side="right"))
            high = int(last[max(fit - 1, np.searchsorted(last, low, side="right"))])
            part = slice(low, high)
            self._pairs(w, rows, counts, relevant_kinds, body[part], term[part], lengths[part], keyword[part])
            low = high

    def _pairs(self, w: Weight, rows, counts, relevant_kinds, body, term, lengths, keyword) -> None:
        n, first = len(w.base), body[0]
        hits = int(lengths.sum())
        at = np.repeat(w.starts[term] - (np.cumsum(lengths) - lengths), lengths) + np.arange(hits)
        key = np.repeat((body - first) * n, lengths) + w.slots[at]
        cells = int(body[-1] - first + 1) * n
        if cells <= 8 * hits:
            overlap = np.bincount(key, minlength=cells)
            pairs = np.flatnonzero(overlap)
            overlap = overlap[pairs]
        else:
            pairs, overlap = np.unique(key, return_counts=True)
        owner = pairs // n
        slot = pairs - owner * n
        owner += first
        relevant = (overlap * 5 >= counts[owner]) | (overlap >= 2)
        if keyword.any():
            relevant |= np.isin(pairs, key[np.repeat(keyword, lengths)])
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(starts, len(owner)))
        met = owner[starts]
        relevant_kinds[met] |= np.bitwise_or.reduceat(w.kinds[slot] * relevant, starts)

        score = w.base[slot] + (overlap << _OVERLAP) + relevant * _RELEVANT
        cited = self.best.shape[1]
        best, slots = self.best[rows[met]], self.slots[rows[met]]
        for _ in range(cited):
            found = np.maximum.reduceat(score, starts)
            score[score == np.repeat(found, sizes)] = -1
            place = (1 << _OVERLAP) - 1 - (found & ((1 << _OVERLAP) - 1))
            best = np.column_stack([best, found])
            slots = np.column_stack([slots, np.where(found < 0, -1, place + w.first)])
        # slots of two weights never tie, so the score alone is their order
        order = np.argsort(-best, axis=1, kind="stable")[:, :cited]
        self.best[rows[met]] = np.take_along_axis(best, order, 1)
        self.slots[rows[met]] = np.take_along_axis(slots, order, 1)

    def to_arrow(self, evidence: Evidence) -> pa.StructArray:
        cited = self.slots >= 0
        slots = self.slots[cited]
        rank = np.broadcast_to(np.arange(1, self.slots.shape[1] + 1, dtype=np.int32), cited.shape)[cited]
        entries = pa.StructArray.from_arrays(
            [pa.array(rank), evidence.ids.take(pa.array(slots)), pa.array(evidence.contexts[slots].astype(np.int32)), pa.array(self.best[cited] >= _RELEVANT)],
            ["rank", "evidence_id", "context", "relevant"],
        )
        top = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(cited.sum(axis=1))).astype(np.int32)), entries)
        return pa.StructArray.from_arrays(
            [pa.array(self.covered), *[pa.array(self.flags[name]) for name in FLAGS], top], ["covered_terms", *FLAGS, "top"]
        )


def facts_of(evidence: Evidence, cited: int, profile: pa.Array, terms: pa.Array, keywords: pa.Array, anchors: pa.Array) -> pa.StructArray:
    """Facts and the ``cited`` best evidence rows of each requirement of a batch; none without terms."""
    facts = _Facts(len(profile), cited)
    names = pc.dictionary_encode(profile)
    numbers = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
    order = np.argsort(numbers, kind="stable")
    low = np.searchsorted(numbers[order], np.arange(len(names.dictionary) + 1))
    for i, name in enumerate(names.dictionary.to_pylist()):
        if name in evidence.profiles:
            rows = order[low[i]:low[i + 1]]
            mine = [terms, keywords, anchors] if len(rows) == len(profile) else [c.take(pa.array(rows)) for c in (terms, keywords, anchors)]
            facts.meet(evidence.profiles[name], rows, *mine)
    return facts.to_arrow(evidence)


def facts_column(evidence: Evidence, cited: int, *columns: str) -> Column:
    """``facts_of`` as a column of profile, terms, keyword terms and anchors."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield facts_of(evidence, cited, *batch)

    return F.arrow_udf(run, FACTS)(*columns)
