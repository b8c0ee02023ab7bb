"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation several times, each time with a few turns more.  A rolling hash of every
prefix of turns finds them: the prefix hash is the exclusive-or of the hashes of (place, role, text) up
to a turn, so it can be rolled over pieces of a conversation in parallel.  A conversation whose full hash
occurs as the hash of a shorter part of another one is a snapshot and goes (anti-join); of equal
conversations the one with the smallest id stays.  What is left is rendered, one marked block per turn.

Turns are numbered, hashed and rolled in buckets of ``BUCKET`` turn numbers, with the totals of the
buckets before them added by a second, small window; a conversation that holds a large share of all
turns is thus spread over many tasks.  Prefix hashes are made distinct before the anti-join, so a first
turn that very many conversations share is one row there.

Defined cases
* null role is rendered as ``user``, null text as empty; both hash as what they are rendered as
* turns are ordered by ``turn`` (null first), then role, then text; gaps do not matter, a repeated
  turn number is two turns
* null ``conv_id``: such turns form one conversation with a null id
* equal conversations (ties): the smallest id stays; empty texts are turns like any other
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitweave.llm.common import materialize, spread_join

BUCKET = 512
OPENING, CLOSING = "<|", "|>"
NO_ID = -(2**63)  # stands for a null conversation id inside this module


def _earlier(rows: DataFrame, **totals: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """``rows`` with what the earlier buckets of their conversation add up to.

    The window holds one row per bucket, not per turn.
    """
    before = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv", "bucket").agg(*(total.alias(name) for name, (total, _) in totals.items()))
    sums = parts.select(
        "conv", "bucket", *(F.coalesce(fold(name).over(before), F.lit(0)).alias(name) for name, (_, fold) in totals.items())
    )
    return rows.join(sums, ["conv", "bucket"])


def rolled(turns: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """conv, place (from 1), role, text, and h1, h2: the hash of the prefix that ends here."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"),
        F.coalesce(F.floor(F.col("turn") / bucket), F.lit(NO_ID)).cast("long").alias("bucket"),
        "turn",
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    in_bucket = Window.partitionBy("conv", "bucket")
    rank = F.row_number().over(in_bucket.orderBy("turn", "role", "text"))
    placed = _earlier(rows, n=(F.count(F.lit(1)), F.sum)).withColumn("place", F.col("n") + rank).drop("n", "turn")
    hashed = placed.withColumns({
        "t1": F.xxhash64("place", "role", "text"),
        "t2": F.xxhash64(F.lit(17), "text", "role", "place"),
    })
    hashed = materialize(hashed, "hashed-turns")
    so_far = in_bucket.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _earlier(hashed, x1=(F.bit_xor("t1"), F.bit_xor), x2=(F.bit_xor("t2"), F.bit_xor)).select(
        "conv", "place", "role", "text",
        *(F.bit_xor(f"t{n}").over(so_far).bitwiseXOR(F.col(f"x{n}")).alias(f"h{n}") for n in (1, 2)),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv and n_turns of the conversations that stay."""
    ends = prefixes.groupBy("conv").agg(F.max(F.struct("place", "h1", "h2")).alias("end"))
    ends = materialize(ends.select("conv", "end.*"), "chat-ends")
    whole = ends.groupBy("place", "h1", "h2").agg(F.min("conv").alias("conv"))
    sizes = ends.select("conv", F.col("place").alias("n_turns"), F.col("place").alias("n"))
    rows = prefixes.withColumn("doc_id", F.col("place"))
    shorter = spread_join(rows, sizes, "conv", "n").where("place < n_turns").select("place", "h1", "h2").distinct()
    return whole.join(shorter, ["place", "h1", "h2"], "left_anti").select("conv", F.col("place").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and text: the turns in order, each as a marked block.

    A group is one conversation, whose rendered form is one row by nature.
    """
    block = F.concat(F.lit(OPENING), "role", F.lit(CLOSING + "\n"), "text", F.lit("\n"))
    listed = turns.select("conv", F.struct("place", block.alias("block")).alias("turn"))
    whole = listed.groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select(
        F.nullif("conv", F.lit(NO_ID)).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.block"), "").alias("text"),
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """Rendered maximal conversations."""
    prefixes = materialize(rolled(turns), "prefixes")
    stay = materialize(maximal(prefixes.select("conv", "place", "h1", "h2")), "chats-kept")
    kept = spread_join(prefixes.withColumn("doc_id", F.col("place")), stay.withColumn("n", F.col("n_turns")), "conv", "n")
    return render(kept)
