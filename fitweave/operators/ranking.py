"""Keep-one and numbering operators that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitweave.session import materialize


def keep_one(rows: DataFrame, keys: list[str], order: list[Column], *, last: bool = False) -> DataFrame:
    """The first (or last) row per key as an aggregate.

    Equal to ``row_number() = 1`` for a unique order, but partial aggregation reduces a
    hot key inside every input task before the shuffle.
    """
    values = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*values), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(row).select(*keys, *[F.col("_row")[c].alias(c) for c in values])


def number_rows(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Exact ``row_number`` over (keys, order) without putting a key into one task.

    Rows are dealt by range of keys and order; Spark takes the splitters from samples of all tasks,
    so a hot key, or a hot stretch of one, is cut into as many ranges as its share asks for.  The sorted
    rows are written once with their place in their task, and shifted by the sizes of the tasks before.
    Null keys are a group of their own.
    """
    by = [*map(F.col, keys), *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_task", F.shiftright("_row", 33)), "numbered")
    parts = placed.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_size"), F.min("_row").alias("_first"))
    # one row per key and task: a key has at most as many as there were tasks
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_task").alias("_part"),
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = placed["_task"] == shifts["_part"]
    for k in keys:
        same &= placed[k].eqNullSafe(shifts[f"_key_{k}"])
    number = (F.col("_row") + F.col("_shift") + 1).cast("long").alias(name)
    return placed.join(shifts, same).select(*rows.columns, number)
