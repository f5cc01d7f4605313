"""For each row the last row of another table at or before its time, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], tie: list[str], width: int = 86_400, at_most: str | None = None) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the row of ``right`` with the same ``key`` and the greatest ``time`` that isn't later.

    Of rows of equal time the one with the greatest ``tie`` counts. ``at_most``: an interval; an older row is no match. Rows
    of ``left`` without key, time or match get nulls; those of ``right`` without key or time match nothing. ``columns`` may
    not be columns of ``left``.

    Keys are cut into slices of time (``width`` seconds), so one with very many rows fills many tasks. Within a slice a window takes
    the last row seen; what a slice begins with follows from the last row of each earlier slice, one narrow row a slice.
    """
    if clash := set(columns) & set(left.columns):
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    slice_of = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width).alias("_slice")
    known = right.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    answer = F.struct(F.col(time).alias("_t"), *columns)
    rank = F.struct(*tie) if tie else F.lit(None)
    asked = left.select(F.col(key).alias("_k"), F.col(time).alias("_time"), slice_of(F.col(time)), F.struct(*left.columns).alias("_row"))
    offered = known.select(F.col(key).alias("_k"), F.col(time).alias("_time"), slice_of(F.col(time)), answer.alias("_answer"), rank.alias("_tie"))
    placed = F.col("_k").isNotNull() & F.col("_time").isNotNull()
    both = asked.where(placed).unionByName(offered, allowMissingColumns=True)
    # At one time the offered rows come first, the greatest of them last.
    order = [F.col("_time"), F.col("_row").isNotNull(), F.col("_tie")]
    so_far = Window.partitionBy("_k", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_own", F.last("_answer", ignorenulls=True).over(so_far)).where("_row is not null")
    lasts = offered.groupBy("_k", "_slice").agg(F.max_by("_answer", F.struct("_time", "_tie")).alias("_last"))
    slices = lasts.unionByName(asked.where(placed).groupBy("_k", "_slice").agg(F.lit(None).alias("_last")))
    slices = slices.groupBy("_k", "_slice").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).where("_carried is not null").drop("_last")
    rows = seen.join(carried, ["_k", "_slice"], "left").select("_row", "_time", F.coalesce("_own", "_carried").alias("_a"))
    if at_most is not None:
        rows = rows.withColumn("_a", F.when(F.col("_a._t") >= F.col("_time") - F.expr(f"interval '{at_most}'"), F.col("_a")))
    rows = rows.select("_row", "_a").unionByName(asked.where(~placed).select("_row"), allowMissingColumns=True)
    return rows.select("_row.*", *[F.col(f"_a.{c}").alias(c) for c in columns])
