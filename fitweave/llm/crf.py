"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's evidence comes from its own shape and that of the lines before and
after it (shares of character classes, word lengths, repeats); a transition weight ties neighbouring
labels.  Forward-backward gives each line's probability of being good, and the mean of these, weighted by
line length, is the document's quality.

Only documents are labelled, so in training every line carries its document's label.  The field is fitted
on the driver on at most ``SAMPLE_DOCS`` labelled documents, those with the smallest hash of their id,
of which at most ``SAMPLE_LINES`` lines each are used: of longer ones ``RUNS`` evenly spaced runs of lines, each a
chain of its own, whose features come from the lines that really lie before and after.  What is collected are line
features, not texts, of one row per id.  A last step fits slope and offset of the score on the same documents, so that scores are
probabilities.  Scoring reads every document whole.

Features depend on the text alone; labels, language, source and id are never inputs of a score.

Defined cases
* null text counts as empty; an empty text is one empty line and gets a score like any other
* null ``doc_id`` is scored and never trained on; its hold-out remainder is that of the empty text
* repeated rows get one result row each and the same score; labels that are null or repeated: null ones
  are left out, of repeated ones the lowest counts
* without labels of both kinds every document gets the share of good labels (0.5 without any)
* an empty table gives an empty result; extra columns are ignored by ``score_documents`` and kept by
  ``keep_good``, where a repeated id stays if any of its rows is good
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitweave.llm.common import without_ids

SAMPLE_DOCS = 6000
SAMPLE_LINES = 64
RUNS = 4
THRESHOLD = 0.3
ROUNDS = 150
LEARNING_RATE = 0.05
RIDGE = 1e-4
SPACE = bytes(range(9, 14)) + b" "

# bounds of the levels of each shape value
SHARES = (0.0, 0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8)
SIZES = (0.0, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 512.0)
LENGTHS = (0.0, 2.0, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 8.0, 12.0)
BOUNDS = (SHARES,) * 7 + (SIZES, LENGTHS, SHARES, SHARES)
LEVELS = len(SHARES) + 1
VALUES = len(BOUNDS)


def _classes() -> np.ndarray:
    """Class of each byte: 1 upper case, 2 digit, 3 mark, 4 space, 5 byte inside a character, 6 line feed."""
    out = np.zeros(256, np.uint8)
    for code in range(128):
        char = chr(code)
        out[code] = 1 if char.isupper() else 2 if char.isdigit() else 4 if code in SPACE else 0 if char.isalpha() else 3
    out[0x80:0xC0] = 5
    out[10] = 6
    return out


CLASSES = _classes()
COMMON_MARKS = np.isin(np.arange(256), list(b".,'"))


def line_levels(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Levels (lines by values) and lengths in characters of all lines of a text."""
    data = (text or "").encode()
    codes = np.frombuffer(data + b"\n", np.uint8)
    kinds = CLASSES[codes]
    ends = np.flatnonzero(kinds == 6)
    starts = np.append(0, ends[:-1] + 1)

    def per_line(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, starts, dtype=np.int64).astype(float)  # a line feed is in none of the masks

    chars = ends - starts - per_line(kinds == 5)
    upper, digit, mark, space = (per_line(kinds == k) for k in (1, 2, 3, 4))
    odd = per_line((kinds == 3) & ~COMMON_MARKS[codes])
    n = np.maximum(chars, 1)
    words = np.zeros(len(ends))
    distinct, again = np.ones(len(ends)), np.zeros(len(ends))
    for at, line in enumerate(data.split(b"\n")):
        found = line.split()
        words[at] = len(found)
        if len(found) > 1:
            again[at] = sum(map(eq, found, found[1:])) / (len(found) - 1)
            # in pieces of 32 words, so that long lines of ordinary text do not look repetitive
            distinct[at] = sum(len(set(found[i : i + 32])) for i in range(0, len(found), 32)) / len(found)
    w = np.maximum(words, 1)
    values = (upper / n, digit / n, mark / n, odd / n, space / n, again, 1 - distinct, words, (chars - space) / w, mark / w, odd / w)
    levels = np.stack([np.searchsorted(b, v, "left") for b, v in zip(BOUNDS, values, strict=True)], axis=1)
    return levels.astype(np.uint8), chars + 1


def neighbour_columns(levels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Weight numbers of each line: its own levels and those of the lines before and after it.

    ``first`` marks the first line of each document.  Missing neighbours share one number.
    """
    step = VALUES * LEVELS
    own = levels + np.arange(VALUES) * LEVELS
    before, after = np.roll(own, 1, axis=0) + step, np.roll(own, -1, axis=0) + 2 * step
    before[first] = 3 * step
    after[np.roll(first, -1)] = 3 * step
    return np.concatenate([own, before, after], axis=1)


WEIGHTS = 3 * VALUES * LEVELS + 1


@dataclass(frozen=True)
class Field:
    """Evidence for "good" by weight number, a bias, and the transition weights [from, to]."""

    weights: np.ndarray
    bias: float
    links: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = np.maximum(a, b)
    return top + np.log1p(np.exp(-np.abs(a - b)))


def forward_backward(evidence: np.ndarray, lengths: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of padded chains (documents by lines): log-probability pairs are summed over all labellings.

    Returns the probability of "good" per line, and of "good" or "bad" on both ends of each link
    (documents by lines - 1 by from by to).  Chains must be sorted by falling length.
    """
    docs, most = evidence.shape
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(most)]  # chains longer than t
    score = np.stack([np.zeros_like(evidence), evidence], axis=2)
    ahead = score.copy()
    for t in range(1, most):
        k = alive[t]
        for to in (0, 1):
            ahead[:k, t, to] += _log_sum(ahead[:k, t - 1, 0] + links[0, to], ahead[:k, t - 1, 1] + links[1, to])
    back = np.zeros_like(score)
    for t in range(most - 2, -1, -1):
        k = alive[t + 1]
        for source in (0, 1):
            back[:k, t, source] = _log_sum(*(links[source, to] + score[:k, t + 1, to] + back[:k, t + 1, to] for to in (0, 1)))
    whole = _log_sum(ahead[:, 0, 0] + back[:, 0, 0], ahead[:, 0, 1] + back[:, 0, 1])[:, None]
    good = np.exp(ahead[:, :, 1] + back[:, :, 1] - whole)
    pairs = np.zeros((docs, max(0, most - 1), 2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pairs[:, :, a, b] = np.exp(ahead[:, :-1, a] + links[a, b] + score[:, 1:, b] + back[:, 1:, b] - whole)
    return good, pairs


def _chains(lengths: np.ndarray, limit: int = 1 << 18) -> Iterator[np.ndarray]:
    """Document numbers by falling length, in groups whose padded size stays bounded."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        size = max(1, limit // int(lengths[order[at]]))
        yield order[at : at + size]
        at += size


def marginals(field: Field, columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of "good" of every line of documents that lie one after the other."""
    evidence = field.weights[columns].sum(axis=1) + field.bias
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(evidence))
    for group in _chains(lengths):
        cells = np.arange(lengths[group[0]])[None, :]
        inside = cells < lengths[group][:, None]
        where = np.where(inside, starts[group][:, None] + cells, 0)
        good, _ = forward_backward(np.where(inside, evidence[where], 0.0), lengths[group], field.links)
        out[where[inside]] = good[inside]
    return out


def document_scores(field: Field, texts: list[str | None]) -> np.ndarray:
    if field.constant is not None:
        return np.full(len(texts), field.constant)
    lines = [line_levels(t) for t in texts]
    lengths = np.array([len(levels) for levels, _ in lines], np.int64)
    starts = np.cumsum(lengths) - lengths
    first = np.zeros(lengths.sum(), bool)
    first[starts] = True
    good = marginals(field, neighbour_columns(np.concatenate([x for x, _ in lines]), first), lengths)
    weight = np.concatenate([w for _, w in lines])
    mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    return _calibrated(field, mean)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _calibrated(field: Field, mean: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(field.slope * _logit(mean) + field.offset)))


def sample_runs(n: int, lines: int) -> tuple[np.ndarray, list[int]]:
    """Line numbers that are trained on of a document of ``n`` lines, at most ``lines``, and the lengths of their runs."""
    if n <= lines:
        return np.arange(n), [n]
    runs = max(1, min(RUNS, lines))
    length = lines // runs
    starts = [k * (n - length) // max(1, runs - 1) for k in range(runs)]
    return np.concatenate([np.arange(a, a + length) for a in starts]), [length] * runs


def fit(columns: np.ndarray, weight: np.ndarray, runs: list[list[int]], label: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Conditional likelihood of the line labels by Adam; then the scale of the document score.

    ``columns`` and ``weight`` have the lines of all documents, ``runs`` the lengths of each document's runs.
    """
    share = float(label.mean()) if len(label) else 0.5
    if not len(label) or label.min() == label.max():
        return Field(np.zeros(WEIGHTS), 0.0, np.zeros((2, 2)), constant=share)
    whole = np.array([sum(r) for r in runs], np.int64)
    per_chain = np.array([len(r) for r in runs], np.int64)
    lengths = np.concatenate([np.array(r, np.int64) for r in runs])
    starts = np.cumsum(lengths) - lengths
    # each document counts once, and both labels the same
    per_doc = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum()) / whole
    chain_label, chain_scale = np.repeat(label, per_chain), np.repeat(per_doc, per_chain)
    groups = []
    for group in _chains(lengths):
        cells = np.arange(lengths[group[0]])[None, :]
        inside = cells < lengths[group][:, None]
        groups.append((group, inside, np.where(inside, starts[group][:, None] + cells, 0)))
    state = np.zeros(WEIGHTS + 5)
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1):
        weights, bias, links = state[:WEIGHTS], state[WEIGHTS], state[WEIGHTS + 1 :].reshape(2, 2)
        evidence = weights[columns].sum(axis=1) + bias
        slope = np.zeros_like(state)
        error = np.zeros(len(evidence))
        for group, inside, where in groups:
            good, pairs = forward_backward(np.where(inside, evidence[where], 0.0), lengths[group], links)
            y, scale = chain_label[group], chain_scale[group]
            error[where[inside]] = ((good - y[:, None]) * scale[:, None])[inside]
            if pairs.shape[1]:
                linked = inside[:, 1:].astype(float)
                expected = np.einsum("dtab,dt,d->ab", pairs, linked, scale)
                seen = np.array([[((y == a) * (a == b) * linked.sum(axis=1) * scale).sum() for b in (0, 1)] for a in (0, 1)])
                slope[WEIGHTS + 1 :] += (expected - seen).ravel()
        slope[:WEIGHTS] = np.bincount(columns.ravel(), np.repeat(error, columns.shape[1]), WEIGHTS)
        slope[WEIGHTS] = error.sum()
        slope += RIDGE * state
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        state = state - LEARNING_RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field = Field(state[:WEIGHTS], float(state[WEIGHTS]), state[WEIGHTS + 1 :].reshape(2, 2))
    documents = np.cumsum(whole) - whole
    mean = np.add.reduceat(marginals(field, columns, lengths) * weight, documents) / np.add.reduceat(weight, documents)
    x, a, b = _logit(mean), 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit with a little ridge
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p)
        gradient = np.array([((p - label) * x).sum() + 1e-2 * a, (p - label).sum() + 1e-2 * b])
        curve = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        a, b = np.array([a, b]) - np.linalg.solve(curve, gradient)
    return Field(field.weights, field.bias, field.links, float(a), float(b))


def held_out(column: str = "doc_id") -> Column:
    """True for the fifth of the documents that are never trained on."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> Field:
    """The field fitted on at most ``sample`` labelled documents outside the held-out fifth."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most `sample` narrow rows, so small enough to send

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, quality in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "quality")), strict=True):
                levels, weight = line_levels(text)
                columns = neighbour_columns(levels, np.arange(len(levels)) == 0).astype(np.uint16)
                picked, runs = sample_runs(len(levels), lines)
                rows.append((doc_id, quality, columns[picked].tobytes(), weight[picked].tobytes(), runs))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "quality", "columns", "weight", "runs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    shaped = texts.mapInArrow(shapes, "id long, quality int, columns binary, weight binary, runs array<int>")
    rows = sorted(one_per_id(shaped).collect(), key=lambda r: r["id"], reverse=True)
    columns = [np.frombuffer(r["columns"], np.uint16).reshape(-1, 3 * VALUES) for r in rows]
    weight = [np.frombuffer(r["weight"], float) for r in rows]
    label = np.array([r["quality"] for r in rows], float)
    empty = np.zeros((0, 3 * VALUES), np.uint16)
    return fit(np.concatenate([empty, *columns]), np.concatenate([[], *weight]), [r["runs"] for r in rows], label)


def one_per_id(shaped: DataFrame) -> DataFrame:
    """The least row of each id, combined before it shuffles."""
    least = F.min(F.struct("columns", "weight", "quality", "runs")).alias("least")
    return shaped.groupBy("id").agg(least).select("id", "least.*")


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and score of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                scores = document_scores(field, batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that the field, trained on the labels, scores at least ``threshold``; all columns."""
    scores = score_documents(docs, train(docs, labels))
    return without_ids(docs, scores.select("doc_id", (F.col("score") >= threshold).alias("stays")))
