"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the id); equal texts are neighbours.  The bounds between
shards are found by counting: each round sends probe keys to all partitions, which return the exact
bytes and rows between neighbouring probes, and every bound whose bytes are not yet within the
tolerance gets finer probes inside its interval.  Texts that hold a large share of the bytes give the
first probes, so a bound inside a huge group of copies is found as fast as any other.  Probes vary the
second key only once an interval has shrunk to one text, so equal texts stay in one shard unless their
group is what a bound has to cut.  Then all rows are exchanged once, into cells that are finer than
shards, sorted and numbered.

The driver sees one number per probe and cell; their count follows ``spark.sql.shuffle.partitions``.

Defined cases
* null text has 0 bytes and the checksum of the empty text; null ``doc_id`` is an id like any other
* empty texts have size 1
* ties (repeated rows with equal id and text) share both keys, so they stay in one cell, in any order
* an empty table gives an empty result; other columns of the input pass through, unless they have a
  name that the operator adds (``shard``, ``slot``): those are replaced
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitweave.llm.common import blank_null, materialize

SHARDS = 8
TOLERANCE = 0.001
LOOSE = 0.1
PROBES = 15
LOW, SPAN = -(2**63), 2**64


def row_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _join_key(first: int, second: int = LOW) -> int:
    return (first - LOW) * SPAN + (second - LOW)


def _split_key(key: int) -> tuple[int, int]:
    return key // SPAN + LOW, key % SPAN + LOW


def cells_of(first: np.ndarray, second: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of bounds at or below each key."""
    b1, b2 = bounds
    left, right = np.searchsorted(b1, first, "left"), np.searchsorted(b1, first, "right")
    for at in np.unique(left[left < right]):
        rows = np.flatnonzero((left == at) & (left < right))
        end = right[rows[0]]
        left[rows] = at + np.searchsorted(b2[at:end], second[rows], "right")
    return left


def _as_arrays(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_split_key(min(k, SPAN * SPAN - 1)) for k in keys]
    return np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)


def _count(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Bytes and rows below each probe, exactly."""
    bounds = _as_arrays(probes)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            cell = cells_of(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")), bounds)
            np.add.at(size, cell, batch.column("size").to_numpy(zero_copy_only=False))
            np.add.at(rows, cell, 1)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_pydict({"cell": used, "size": size[used], "n": rows[used]})

    parts = keys.select("k1", "k2", "size").mapInArrow(partial, "cell long, size long, n long")
    found = {r["cell"]: (r["size"], r["n"]) for r in parts.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()}
    below, out = (0, 0), []
    for cell in range(len(probes)):
        size, rows = found.get(cell, (0, 0))
        below = (below[0] + size, below[1] + rows)
        out.append(below)
    return out


def find_bounds(keys: DataFrame, targets: list[int], slack: list[float], first: list[int], probes: int = PROBES) -> list[tuple[int, int]]:
    """For each target number of bytes a key, and the rows below it.

    ``first`` are keys probed in the first round.  Ends when each bound is within its slack, or its
    interval holds one single key, of which it then takes the nearer side.
    """
    top = SPAN * SPAN
    low = [(0, 0, 0)] * len(targets)
    high = [(top, None, None)] * len(targets)
    done: list[tuple[int, int] | None] = [None] * len(targets)
    ask = set(first)
    while any(d is None for d in done):
        for at, d in enumerate(done):
            if d is None:
                lo, hi = low[at][0], high[at][0]
                step = SPAN if hi - lo > SPAN else 1  # group boundaries first, then ids inside a group
                base, width = -(-lo // step), (hi - lo) // step
                ask.update(k for i in range(1, probes + 1) if lo < (k := (base + width * i // (probes + 1)) * step) < hi)
                ask.update(k for k in (base * step, (hi - 1) // step * step) if lo < k < hi)
        asked = sorted(ask)
        counts = list(zip(asked, _count(keys, asked), strict=True))
        ask = set()
        for at, goal in enumerate(targets):
            if done[at] is not None:
                continue
            for key, (size, rows) in counts:
                if size <= goal and key > low[at][0]:
                    low[at] = (key, size, rows)
                if size > goal and key < high[at][0]:
                    high[at] = (key, size, rows)
            near = [x for x in (low[at], high[at]) if x[1] is not None]
            best = min(near, key=lambda x: abs(x[1] - goal))
            if abs(best[1] - goal) <= slack[at] or high[at][0] - low[at][0] <= 1:
                done[at] = (best[0], best[2])
    return done


def histogram_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard); shards have near equal bytes.

    ``tolerance`` is the part of a shard's bytes by which a bound may miss its place; a bound misses by
    more only where a single row is larger than that.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    names = docs.columns
    inner = [f"in{n}" for n in range(len(names))]  # no name of the input can clash with those used below
    text, doc_id = (inner[names.index(n)] for n in ("text", "doc_id"))
    keyed = docs.toDF(*inner).select(
        "*", F.xxhash64(blank_null(text)).alias("k1"), F.xxhash64(doc_id).alias("k2"), row_size(text).alias("size")
    )
    keys = materialize(keyed.select("k1", "k2", "size"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return docs.select("*", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    per_shard = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    cells = shards * per_shard
    # at most one key per cell can hold a cell's share of the bytes
    heavy = keys.groupBy("k1").agg(F.sum("size").alias("b")).where(F.col("b") >= total / cells).collect()
    first = [k for r in heavy for k in (_join_key(r["k1"]), _join_key(r["k1"]) + SPAN)]
    targets = [total * c // cells for c in range(1, cells)]
    slack = [tolerance * total / shards if c % per_shard == 0 else LOOSE * total / cells for c in range(1, cells)]
    # a cell is empty where a single row is larger than a cell
    bounds = sorted(find_bounds(keys, targets, slack, first))
    arrays = _as_arrays([key for key, _ in bounds])
    starts = [0] + [rows for _, rows in bounds]
    offsets = spark.createDataFrame(
        [(c, c // per_shard, starts[c] - starts[c // per_shard * per_shard]) for c in range(cells)],
        "cell int, shard int, before long",
    )

    @F.pandas_udf("int")
    def cell(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(cells_of(first.to_numpy(), second.to_numpy(), arrays).astype(np.int32))

    order = Window.partitionBy("cell").orderBy("k1", "k2", doc_id)
    numbered = keyed.withColumn("cell", cell("k1", "k2")).withColumn("place", F.row_number().over(order))
    placed = numbered.join(F.broadcast(offsets), "cell")
    return placed.select(
        *(F.col(i).alias(n) for i, n in zip(inner, names, strict=True)),
        "shard",
        (F.col("before") + F.col("place") - 1).alias("slot"),
    )
