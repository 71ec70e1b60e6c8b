"""Daily sketches beside the exact reports: users and conversion times of any window from one small row a day.

Exact distinct counts and medians of a window need all its events again. A day's sketches are written once, merge in any
grouping, and stay a few kilobytes whatever the day holds. Reports keep the exact figures; `beside_exact` measures the error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens.functions.exprs import attach, null_safe_key
from sessionlens.model import MICROS_PER_MINUTE
from sessionlens.sources.events import PARTITION

#: Sizes of the sketches: relative error of users about 1.04 / sqrt(2 ** 12), rank error of times about 1.7 % (both at 99 % under `WITHIN`).
LOG_REGISTERS, KLL_K = 12, 200
WITHIN_USERS, WITHIN_RANK = 0.05, 0.03


def _minutes() -> Column:
    return (F.col("ts_p") - F.col("ts_s")) / F.lit(MICROS_PER_MINUTE)


def daily_sketches(ev: DataFrame, base: DataFrame) -> DataFrame:
    """One row a day: users with a session start that day, minutes to purchase of the converting sessions that began that day.

    A day with neither has no row; where only one is there, the other sketch is null.
    """
    users = (
        ev.where(F.col("event_name") == "session_start")
        .groupBy(F.col(PARTITION).alias("day"))
        .agg(F.hll_sketch_agg("user_pseudo_id", LOG_REGISTERS).alias("users"))
    )
    minutes = (
        base.where("s5").groupBy(F.col("session_date").alias("day"))
        .agg(F.kll_sketch_agg_double(_minutes(), KLL_K).alias("minutes"))
    )
    return users.join(minutes, "day", "full")


def roll_up(days: DataFrame, **by: Column) -> DataFrame:
    """Estimates of the days' rows merged by any grouping of `day` (all of them without one)."""
    merged = days.groupBy(*[value.alias(name) for name, value in by.items()]).agg(
        F.hll_union_agg("users").alias("_users"),
        F.kll_merge_agg_double("minutes").alias("_minutes"),
        F.count("minutes").alias("_timed"),
    )
    timed = F.col("_timed") > 0
    return merged.select(
        *by, F.coalesce(F.hll_sketch_estimate("_users"), F.lit(0)).alias("users_estimate"),
        F.when(timed, F.kll_sketch_get_n_double("_minutes")).otherwise(0).cast("long").alias("conversions"),
        F.when(timed, F.kll_sketch_get_quantile_double("_minutes", F.lit(0.5))).alias("median_estimate"),
    )


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of the one row a group on the right; without keys it is one row for all."""
    if keys:
        return left.join(right, keys, "left")
    return attach(left, right, "_r").select(*left.columns, *[F.col(f"_r.{c}") for c in right.columns])


def beside_exact(days: DataFrame, ev: DataFrame, base: DataFrame, **by: Column) -> DataFrame:
    """The estimates with exact users and conversions, the relative error of users, and how far the median's rank is off.

    `by` are groupings of a column `day`. The rank error is 0 where the estimate's ties reach over the middle.
    """
    names = list(by)
    grouped = lambda df, day: df.withColumn("day", day).withColumns(by)
    users = (
        grouped(ev.where(F.col("event_name") == "session_start"), F.col(PARTITION))
        .groupBy(*names).agg(F.count_distinct("user_pseudo_id").alias("unique_users"))
    )
    key = lambda: [null_safe_key(F.col(n).cast("string")).alias(f"_k{i}") for i, n in enumerate(names)]
    keys = [f"_k{i}" for i in range(len(names))]
    estimates = roll_up(days, **by)
    at = estimates.select(*key(), "median_estimate")
    times = grouped(base.where("s5"), F.col("session_date")).select(*key(), _minutes().alias("_m"))
    ranks = (
        _beside(times, at, keys).groupBy(*keys).agg(
            F.avg((F.col("_m") < F.col("median_estimate")).cast("int")).alias("_below"),
            F.avg((F.col("_m") <= F.col("median_estimate")).cast("int")).alias("_upto"),
        )
    )
    off = F.greatest(F.lit(0.0), F.col("_below") - 0.5, F.lit(0.5) - F.col("_upto"))
    exact = users.select(*key(), "unique_users")
    return (
        _beside(_beside(estimates.select("*", *key()), exact, keys), ranks, keys)
        .withColumn("unique_users", F.coalesce("unique_users", F.lit(0)))
        .withColumn("users_error", F.abs(F.col("users_estimate") - F.col("unique_users")) / F.greatest("unique_users", F.lit(1)))
        .withColumn("rank_error", off)
        .select(*names, "unique_users", "users_estimate", "users_error", "conversions", "median_estimate", "rank_error")
    )
