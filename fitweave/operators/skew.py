"""Equi-join that stays balanced when a few keys hold most rows of either side.

A key is hot on a side if it holds at least ``share`` of that side's rows, so there are never more
than ``2 / share`` hot keys whatever the input size.  That bound makes the key list safe to
broadcast.  Rows of a hot key are cut into as many slices as its count needs to get below the share:
left rows take one left slice and are repeated for every right slice, right rows the other way
round.  Each pair of rows meets exactly once, so the result is the plain join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 0.002
BROADCAST_ROWS = 200_000  # of narrow rows, some 40 MB


def _slices(rows: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """Hot keys of one side and the number of slices they need; the total comes from the counts."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    limit = counts.agg((F.sum("_n") * share).alias("_limit"))
    return counts.where(F.col("_n") > limit.scalar()).select(
        *keys, F.ceil(F.col("_n") / limit.scalar()).cast("int").alias(name)
    )


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[str],
    *,
    how: str = "inner",
    share: float = SHARE,
    counted: DataFrame | None = None,
    spread_right_by: list[str] | None = None,
) -> DataFrame:
    """``left`` joined with ``right`` (inner or left).

    ``spread_by`` names left columns that tell apart the rows of one key.  ``counted`` is a narrow frame
    with the same keys as ``left``, for callers whose left side is costly to compute twice.
    ``spread_right_by`` does the same for a right side that can have many rows per key; without it the right
    side is taken to have few.
    """
    hot = _slices(left if counted is None else counted, keys, share, "_left_slices")
    if spread_right_by:
        hot = hot.join(_slices(right, keys, share, "_right_slices"), keys, "full")
    else:
        hot = hot.withColumn("_right_slices", F.lit(None).cast("int"))
    hot = F.broadcast(hot)

    def own(columns: list[str] | None, count: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.coalesce(F.col(count), F.lit(1))).cast("int") if columns else F.lit(0)

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - 1))

    salts = ["_left_slice", "_right_slice"]
    spread = (
        left.join(hot, keys, "left").withColumn("_left_slice", own(spread_by, "_left_slices"))
        .withColumn("_right_slice", every("_right_slices")).drop("_left_slices")
    )
    repeated = (
        right.join(hot, keys, "left").withColumn("_right_slice", own(spread_right_by, "_right_slices"))
        .withColumn("_left_slice", every("_left_slices")).drop("_left_slices", "_right_slices")
    )
    if how == "inner":
        return spread.drop("_right_slices").join(repeated, [*keys, *salts]).drop(*salts)
    joined = spread.join(repeated.withColumn("_met", F.lit(True)), [*keys, *salts], how)
    # a repeated left row has matches, though maybe none in this slice
    return joined.where(F.col("_met").isNotNull() | F.col("_right_slices").isNull()).drop(*salts, "_met", "_right_slices")


def sized_join(left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], *, how: str = "inner", most: int = BROADCAST_ROWS, **options) -> DataFrame:
    """``balanced_join`` with a written right side of narrow rows, which goes to all tasks if it has at most ``most``.

    Only the way of the join depends on the size: then no row of the left side moves.
    """
    if right.count() <= most:
        return left.join(F.broadcast(right), keys, how)
    return balanced_join(left, right, keys, spread_by, how=how, **options)
