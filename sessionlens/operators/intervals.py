"""Join of points in time with closed intervals of any length, as an equality join on bins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens.functions.exprs import scalars

#: Width of the finest bins where a caller names none: a minute of microseconds.
FINEST = 60 * 10**6
#: Points of one bin above which it is split.
HOT_POINTS = 1_000_000


def _bin(at: Column, level: Column, finest: int) -> Column:
    return F.floor(at / (F.lit(float(finest)) * F.pow(F.lit(2.0), level)))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    at: str,
    start: str,
    end: str,
    finest: int = FINEST,
    materialise: Callable[[DataFrame], DataFrame] | None = None,
    hot_points: int = HOT_POINTS,
) -> DataFrame:
    """Each point with each interval of equal `keys` that holds it (start <= at <= end), once.

    Times are whole numbers. Null keys or times match nothing, nor do intervals that end before they start. `keys` may be empty;
    other columns of the two sides must have different names.

    Bins of a level are twice as wide as those of the level below, and an interval goes to the level whose bins are at least as long as
    itself: it is copied into three bins at most, whether it lasts a second or a year. A point is copied once for each level that has
    intervals, at most 60. With `materialise`, which writes a table and reads it back, points of a bin with more than `hot_points` are dealt over
    parts and the bin's intervals copied into each; the written list of such bins has a known size. Without it, adaptive
    execution splits them.
    """
    length = F.col(end) - F.col(start)
    level = F.greatest(F.lit(0), F.ceil(F.log2((length + 1) / F.lit(float(finest))))).cast("int")
    known = [F.col(k).isNotNull() for k in keys]
    spans = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", level)
    placed = points.where(F.col(at).isNotNull())
    for condition in known:
        spans, placed = spans.where(condition), placed.where(condition)
    levels = scalars(spans.agg(F.collect_set("_level").alias("l")))["l"]
    first, last = (_bin(F.col(c), F.col("_level"), finest) for c in (start, end))
    spans = spans.withColumn("_bin", F.explode(F.sequence(first, last)))
    placed = placed.withColumn("_level", F.explode(levels)).withColumn("_bin", _bin(F.col(at), F.col("_level"), finest))
    place = [*keys, "_level", "_bin"]
    if materialise is not None:
        hot = materialise(
            placed.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_points)
            .select(*place, F.ceil(F.col("_n") / hot_points).cast("int").alias("_parts"))
        )
        parts = F.coalesce("_parts", F.lit(1))
        # which part a point goes to is decided by its whole row, so a task run again deals alike; equal rows stay together
        dealt = F.pmod(F.xxhash64(*points.columns), parts).cast("int")
        placed = placed.join(hot, place, "left").withColumn("_part", dealt).drop("_parts")
        every = F.explode(F.sequence(F.lit(0), parts - 1))
        spans = spans.join(hot, place, "left").withColumn("_part", every).drop("_parts")
        place = [*place, "_part"]
    return (
        placed.join(spans, place)
        .where(F.col(at).between(F.col(start), F.col(end)))
        .select(*points.columns, *[c for c in intervals.columns if c not in keys])
    )
