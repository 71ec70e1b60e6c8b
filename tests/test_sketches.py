"""Daily sketches merged over windows, beside the exact figures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionlens.operators.sketches import WITHIN_RANK, WITHIN_USERS, beside_exact, daily_sketches, roll_up
from sessionlens.sources.staging import stage

DAY = dt.date(2024, 1, 1)


def tables(spark, n):
    """`n` sessions over ten days by a third as many users; every other one converts, after a skewed time."""
    rows = spark.range(n).select(
        (F.col("id") % (n // 3)).cast("string").alias("user_pseudo_id"), F.lit("session_start").alias("event_name"),
        F.date_add(F.lit(DAY), (F.hash("id") % 5 + 5).cast("int")).alias("event_date_part"), F.lit(0).cast("long").alias("ts_s"),
        ((F.abs(F.hash("id")) % 1000) * (F.col("id") % 7) * 60_000_000).cast("long").alias("ts_p"), (F.col("id") % 2 == 0).alias("s5"),
    )
    return rows, rows.withColumnRenamed("event_date_part", "session_date")


@pytest.mark.parametrize("by", [None, "week", "month"])
def test_errors_are_within_their_bounds(spark, by):
    ev, base = tables(spark, 60_000)
    by = {by: F.date_trunc(by, "day")} if by else {}
    days = stage(daily_sketches(ev, base), "sketches")[0]
    got = beside_exact(days, ev, base, **by).collect()
    assert days.count() == 9 and sum(r["conversions"] for r in got) == 30_000
    for r in got:
        assert r["users_error"] <= WITHIN_USERS and r["rank_error"] <= WITHIN_RANK and r["unique_users"] > 0


def test_days_without_conversions_or_users(spark):
    ev, base = tables(spark, 300)
    none = roll_up(daily_sketches(ev, base.where("false"))).first()
    assert none["users_estimate"] == pytest.approx(100, rel=0.05) and none["conversions"] == 0 and none["median_estimate"] is None
    lone = roll_up(daily_sketches(ev.where("false"), base)).first()
    assert lone["users_estimate"] == 0 and lone["conversions"] == 150
    assert roll_up(daily_sketches(ev.where("false"), base.where("false")), day=F.col("day")).count() == 0
