"""Acquisition channels and devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.exprs import attach, pct, ratio, round_half_even, scalars
from sessionlens.functions.stats import wilson_ci
from sessionlens.model import COUNT_COLUMNS, NOT_SET, STEP_COUNTS, STEP_LABELS, STEPS
from sessionlens.operators.inference import BORDERLINE_PP, DRIVER_PP, chi_square, spread_verdict

LOW_N = 30
_METRICS = ("sessions", "view_item", "add_to_cart", "purchase", "revenue")


def channel_table(
    counts: DataFrame, min_share: float = 1.0, min_coverage: float = 0.5, low_n: int = LOW_N
) -> DataFrame:
    """Channels of the two-way funnel: basis by tag coverage, small ones pooled, shares and rates."""
    total = counts.agg(
        F.sum("sessions").alias("n"),
        F.sum(F.when(F.col("session_medium") == NOT_SET, F.col("sessions")).otherwise(0)).alias("untagged"),
    )
    covered = 1 - F.col("_t.untagged") / F.col("_t.n") >= min_coverage
    sums = [F.sum(c).alias(c) for c in _METRICS]
    by_channel = (
        attach(counts, total, "_t")
        .withColumn("basis", F.when(covered, "session_medium").otherwise("first_touch_medium"))
        .groupBy(
            F.when(F.col("basis") == "session_medium", F.col("session_medium"))
            .otherwise(F.col("first_touch_medium")).alias("channel"),
            "basis", F.col("_t.n").alias("total"),
        )
        .agg(*sums)
        .withColumn("small", F.col("sessions") / F.col("total") < F.lit(min_share / 100))
    )
    n_small = F.col("_s.n")
    pooled = F.concat(F.lit("other ("), n_small.cast("string"), F.lit(" small channels)"))
    regrouped = (
        attach(by_channel, by_channel.agg(F.count_if("small").alias("n")), "_s")
        .groupBy(F.when(F.col("small") & (n_small > 1), pooled).otherwise(F.col("channel")).alias("channel"), "basis", "total")
        .agg(*sums)
    )
    return regrouped.select(
        "channel", "sessions", "view_item", "add_to_cart", "purchase", F.round("revenue", 2).alias("revenue"),
        pct("sessions", "total").alias("share"),
        pct("view_item", "sessions").alias("view_pct"),
        pct("add_to_cart", "view_item").alias("cart_from_view"),
        pct("purchase", "sessions").alias("purch_pct"),
        ratio(F.round("revenue", 2), "sessions").alias("rev_per_session"),
        (F.col("purchase") < low_n).alias("low_n"),
        "basis",
    ).orderBy(F.desc("sessions"), "channel")


def _named(channels: DataFrame) -> DataFrame:
    """Real channels: not the pooled row and not '(not set)'; every row when none is named."""
    named = ~(F.col("channel").startswith("other (") | F.col("channel").startswith(NOT_SET))
    any_named = scalars(channels.agg(F.count_if(named).alias("n")))["n"] > 0
    return channels.where(named | ~any_named)


def channel_verdict(
    channels: DataFrame, driver_pp: float = DRIVER_PP, borderline_pp: float = BORDERLINE_PP
) -> DataFrame:
    """Is the discovery loss a matter of channels? Spread of the view rate over named channels.

    The verdict uses the unrounded spread; ties go to the larger channel, then by name.
    """
    named = _named(channels)
    best = F.min(F.struct(-F.col("view_pct"), -F.col("sessions"), F.col("channel").alias("c"), "view_pct"))
    worst = F.min(F.struct("view_pct", -F.col("sessions"), F.col("channel").alias("c")))
    paying = F.when(
        ~F.col("low_n"),
        F.struct(-F.col("rev_per_session"), -F.col("sessions"), F.col("channel").alias("c"), "rev_per_session"),
    )
    untagged = F.col("channel") == NOT_SET
    ns = channels.agg(
        F.coalesce(F.max(F.when(untagged, F.col("share"))), F.lit(0.0)).alias("notset_share"),
        F.max(F.when(untagged, F.col("view_pct"))).alias("notset_view_pct"),
    )
    ends = named.agg(best.alias("b"), worst.alias("w"), F.min(paying).alias("r"))
    ends = attach(attach(ends, chi_square(named, "view_item", "sessions"), "_t"), ns, "_n")
    spread = F.col("b.view_pct") - F.col("w.view_pct")
    return ends.select(
        F.col("b.c").alias("best_channel"), F.col("b.view_pct").alias("best_view_pct"),
        F.col("w.c").alias("worst_channel"), F.col("w.view_pct").alias("worst_view_pct"),
        spread.alias("spread_pp"), spread_verdict(spread, driver_pp, borderline_pp).alias("verdict"),
        "_t.*",
        F.col("r.c").alias("top_rev_channel"), F.col("r.rev_per_session").alias("top_rev_per_session"),
        "_n.*",
    )


def medium_agreement(counts: DataFrame) -> DataFrame:
    """Share of sessions whose own medium equals the user's first-touch medium."""
    same = F.when(F.col("session_medium") == F.col("first_touch_medium"), F.col("sessions")).otherwise(0)
    return counts.agg(
        F.sum("sessions").alias("sessions"), F.sum(same).alias("agreeing"),
        pct(F.sum(same), F.sum("sessions")).alias("agreement_pct"),
    )


def medium_crosstab(counts: DataFrame) -> DataFrame:
    """Sessions by first touch and session medium, in long form: every medium that occurs."""
    pair = ("first_touch_medium", "session_medium")
    return counts.groupBy(*pair).agg(F.sum("sessions").alias("sessions")).orderBy(*pair)


def device_table(counts: DataFrame) -> DataFrame:
    """Share and rates per device, Wilson interval of the purchase rate, gap and test over devices."""
    total = scalars(counts.agg(F.sum("sessions").alias("n")))["n"]
    rate = pct("purchase", "sessions")
    gap = counts.agg(
        round_half_even(F.max(rate) - F.min(rate), 2).alias("gap_pp"),
        F.min(F.struct(-rate, -F.col("sessions"), F.col("device_category").alias("d")))["d"].alias("top"),
    )
    lo, hi = wilson_ci("purchase", "sessions")
    rows = attach(attach(counts, gap, "_g"), chi_square(counts, "purchase", "sessions"), "_t")
    return rows.select(
        "device_category", "sessions", "purchase", pct("sessions", total).alias("share"),
        pct("view_item", "sessions").alias("view_pct"), pct("add_to_cart", "sessions").alias("cart_pct"),
        rate.alias("purch_pct"), lo.alias("ci_lo"), hi.alias("ci_hi"),
        "_g.gap_pp", (F.col("device_category") == F.col("_g.top")).alias("is_top"), "_t.*",
    ).orderBy(F.desc("sessions"), "device_category")


def device_steps(counts: DataFrame) -> DataFrame:
    """Long form: one row per device and step, percent of the device's sessions."""
    long = counts.select("device_category", F.col("sessions").alias("base"), *COUNT_COLUMNS).unpivot(
        ["device_category", "base"], list(COUNT_COLUMNS), "step_column", "n"
    )
    index = F.array_position(F.array(*[F.lit(STEP_COUNTS[s]) for s in STEPS]), F.col("step_column"))
    label = F.get(F.array(*[F.lit(STEP_LABELS[s]) for s in STEPS]), (index - 1).cast("int"))
    return long.select(
        "device_category", index.alias("step_order"), label.alias("step"), F.col("n").alias("sessions"),
        round_half_even(pct("n", "base"), 2).alias("pct"),
    ).orderBy("device_category", "step_order")
