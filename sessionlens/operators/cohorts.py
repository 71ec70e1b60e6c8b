"""Weekly cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.exprs import attach, pct, round_half_even, scalars, week_start
from sessionlens.model import NOT_SET, EventWindow


def _starts(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("event_name") == "session_start")


def user_activity(ev: DataFrame) -> DataFrame:
    """One row per user and week with a session_start."""
    return _starts(ev).select("user_pseudo_id", week_start("event_date").alias("activity_week")).distinct()


def user_cohorts(ev: DataFrame) -> DataFrame:
    """Each user's cohort week: Monday of the first session_start day."""
    return _starts(ev).groupBy("user_pseudo_id").agg(F.min(week_start("event_date")).alias("cohort_week"))


def user_weeks(ev: DataFrame) -> DataFrame:
    """One row per user with a session_start: its earliest start, cohort week and active weeks, and whether a start has no week.

    The weeks are a set that the window bounds, and tasks combine theirs before one shuffle: cohorts and their
    channels both read this table instead of grouping, moving and sorting all starts again.
    """
    week = week_start("event_date")
    return (
        _starts(ev).select("user_pseudo_id", "event_timestamp", "session_id", week.alias("wk"))
        .groupBy("user_pseudo_id")
        .agg(
            F.min(F.struct("event_timestamp", "session_id", "wk")).alias("first"), F.min("wk").alias("cohort_week"),
            F.collect_set("wk").alias("weeks"), F.bool_or(F.col("wk").isNull()).alias("undated"),
        )
    )


def cohorts(ev: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Users active in each week since their cohort week; `users` is `user_weeks(ev)`, if it has been written already."""
    users = user_weeks(ev) if users is None else users
    weeks = F.when(F.col("undated"), F.array_append("weeks", F.lit(None).cast("date"))).otherwise(F.col("weeks"))
    return (
        users.where(F.col("user_pseudo_id").isNotNull())
        .select("cohort_week", F.explode(weeks).alias("activity_week"))
        .groupBy("cohort_week", (F.datediff("activity_week", "cohort_week") / 7).cast("long").alias("weeks_since_cohort"))
        .agg(F.count("*").alias("active_users"))
        .orderBy("cohort_week", "weeks_since_cohort")
    )


def retention_matrix(counts: DataFrame, window: EventWindow) -> DataFrame:
    """Long form: a week counts only when fully inside the window (else null); observed and absent is 0.

    The offsets are those occurring in the data. Both grid axes are weeks of the window.
    """
    top = scalars(counts.agg(F.max("weeks_since_cohort").alias("k")))["k"]
    offsets = counts.select("weeks_since_cohort").distinct()
    sizes = counts.groupBy("cohort_week").agg(
        F.max(F.when(F.col("weeks_since_cohort") == 0, F.col("active_users"))).alias("week0")
    )
    grid = sizes.select(
        "cohort_week", "week0", F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("weeks_since_cohort")
    ).join(offsets, "weeks_since_cohort", "left_semi")
    last = F.lit(window.last_day)
    seen = lambda offset: F.date_add("cohort_week", (offset * 7 + 6).cast("int")) <= last
    users = F.when(seen(F.col("weeks_since_cohort")), F.coalesce("active_users", F.lit(0)))
    size = F.when(seen(F.lit(0)), F.coalesce("week0", F.lit(0)))
    return (
        grid.join(counts, ["cohort_week", "weeks_since_cohort"], "left")
        .select("cohort_week", "weeks_since_cohort", size.alias("cohort_size"), users.alias("active_users"))
        .withColumn("retention_pct", pct("active_users", "cohort_size"))
        .orderBy("cohort_week", "weeks_since_cohort")
    )


def cohort_eligibility(df: DataFrame, window: EventWindow) -> DataFrame:
    """Flags per cohort_week: full cohort (does not start before the window), week 1 observed."""
    return df.withColumns(
        {
            "full_cohort": F.col("cohort_week") >= F.lit(window.first_day),
            "week1_observed": F.date_add("cohort_week", 13) <= F.lit(window.last_day),
        }
    )


def _full(matrix: DataFrame, window: EventWindow) -> DataFrame:
    return matrix.where(F.col("cohort_week") >= F.lit(window.first_day))


def retention_averages(matrix: DataFrame, window: EventWindow) -> DataFrame:
    """Mean week-1 and week-2 return over full cohorts; unobserved cells are skipped (one row).

    Averages the unrounded percentages and rounds once.
    """
    at = lambda k: F.round(F.avg(F.when(F.col("weeks_since_cohort") == k, F.col("retention_pct"))), 1)
    return _full(matrix, window).agg(
        at(1).alias("avg_wk1"), at(2).alias("avg_wk2"),
        F.count_if((F.col("weeks_since_cohort") == 1) & F.col("retention_pct").isNotNull()).alias("cohorts_wk1"),
    )


def retention_by_month(matrix: DataFrame, window: EventWindow) -> DataFrame:
    """Week-1 return by cohort month (year and month): range, mean, peak and trough."""
    months = (
        _full(matrix, window)
        .where((F.col("weeks_since_cohort") == 1) & F.col("retention_pct").isNotNull())
        .groupBy(F.date_format("cohort_week", "yyyy-MM").alias("month"))
        .agg(
            round_half_even(F.min("retention_pct"), 1).alias("lo"), round_half_even(F.max("retention_pct"), 1).alias("hi"),
            F.count("*").alias("n"), F.avg("retention_pct").alias("mean"),
        )
    )
    ends = months.agg(
        F.min(F.struct(-F.col("mean"), "month"))["month"].alias("peak"),
        F.min(F.struct("mean", "month"))["month"].alias("trough"),
    )
    return attach(months, ends, "_e").select(
        "month", "lo", "hi", "n", F.round("mean", 6).alias("mean_pct"),
        (F.col("month") == F.col("_e.peak")).alias("is_peak"),
        (F.col("month") == F.col("_e.trough")).alias("is_trough"),
    ).orderBy("month")


def cohort_channel(ev: DataFrame, base: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Week-1 return by cohort week and medium of the user's first session.

    The first session's medium stands in the session table `base`, so of the events only session starts are read;
    `users` is `user_weeks(ev)`, if it has been written already.
    """
    users = user_weeks(ev) if users is None else users
    first = users.select(
        "user_pseudo_id", F.col("first.session_id").alias("session_id"), F.col("first.wk").alias("cohort_week"),
        F.array_contains("weeks", F.date_add("first.wk", 7)).alias("back"),
    )
    medium = base.where(F.col("session_medium").isNotNull() & F.col("user_pseudo_id").isNotNull()).select(
        "user_pseudo_id", "session_id", F.col("session_medium").alias("medium")
    )
    # A user without an id matches nothing in either lookup.
    back = F.col("back") & F.col("user_pseudo_id").isNotNull()
    return (
        first.join(medium, ["user_pseudo_id", "session_id"], "left")
        .groupBy("cohort_week", F.coalesce("medium", F.lit(NOT_SET)).alias("medium"))
        .agg(F.count("*").alias("users"), F.count_if(back).alias("wk1_users"))
        .orderBy("cohort_week", "medium")
    )


def month_channels(channel_counts: DataFrame, months: DataFrame, which: str, window: EventWindow) -> DataFrame:
    """Users and week-1 returns by medium over the cohorts of the peak or trough month."""
    month = scalars(months.where(F.col(f"is_{which}")).agg(F.min("month").alias("m")))["m"]
    return (
        cohort_eligibility(channel_counts, window)
        .where(F.col("full_cohort") & F.col("week1_observed"))
        .where(F.date_format("cohort_week", "yyyy-MM") == month)
        .groupBy("medium")
        .agg(F.sum("users").alias("users"), F.sum("wk1_users").alias("successes"))
    )
