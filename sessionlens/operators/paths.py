"""Cross-session purchase paths and cart recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.exprs import literal_rows, pct, scalars
from sessionlens.functions.ranks import Materialise, exact_quantiles
from sessionlens.functions.stats import wilson_ci
from sessionlens.model import MICROS_PER_HOUR

# The four paths, in report order.
PATHS = (
    "sequential, in one session",
    "carted in the session, out of order",
    "carted in an earlier session",
    "no cart seen in the window",
)


def purchase_paths(us: DataFrame) -> DataFrame:
    """One row per purchasing session with the path that led to it."""
    earlier = F.col("ts_c").isNull() & F.col("prev_cart_ts").isNotNull()
    path = (
        F.when(F.col("s5"), PATHS[0]).when(F.col("ts_c").isNotNull(), PATHS[1])
        .when(F.col("prev_cart_ts").isNotNull(), PATHS[2]).otherwise(PATHS[3])
    )
    return us.where(F.col("ts_p").isNotNull()).select(
        path.alias("path"), F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.col("rn").alias("session_number_in_window"),
        F.when(earlier, (F.col("ts_p") - F.col("prev_cart_ts")) / F.lit(MICROS_PER_HOUR)).alias("hours_since_cart"),
        F.when(earlier, F.col("rn") - F.col("prev_cart_rn")).alias("sessions_since_cart"),
    )


def cart_recovery(us: DataFrame) -> DataFrame:
    """One row per carting session without a purchase: next purchase of the user, time left to see one.

    Overlapping sessions can give a negative time to the next purchase; it counts as recovered.
    """
    hours = lambda later: (F.col(later) - F.col("ts_c")) / F.lit(MICROS_PER_HOUR)
    return us.where(F.col("ts_c").isNotNull() & F.col("ts_p").isNull()).select(
        F.col("ts_k").isNotNull().alias("reached_checkout"),
        hours("next_purchase_ts").alias("hours_to_next_purchase"),
        hours("window_end_ts").alias("hours_left"),
    )


def purchase_path_summary(paths: DataFrame, materialise: Materialise = None) -> DataFrame:
    """Sessions, share, revenue and exact medians per path; every path always present, in order."""
    counts = paths.groupBy("path").agg(F.count("*").alias("sessions"), F.round(F.sum("revenue"), 2).alias("revenue"))
    measures = F.array(
        F.struct(F.lit("hours").alias("measure"), F.col("hours_since_cart").alias("value")),
        F.struct(F.lit("sessions").alias("measure"), F.col("sessions_since_cart").cast("double").alias("value")),
    )
    long = paths.select("path", F.explode(measures).alias("m")).select("path", "m.*")
    medians = (
        exact_quantiles(long, ["path", "measure"], "value", 0.5, few_groups=True, materialise=materialise)
        .groupBy("path")
        .agg(
            F.max(F.when(F.col("measure") == "hours", F.col("q_cont"))).alias("median_hours_since_cart"),
            F.max(F.when(F.col("measure") == "sessions", F.col("q_cont"))).alias("median_sessions_since_cart"),
        )
    )
    total = scalars(counts.agg(F.sum("sessions").alias("n")))["n"]
    order = literal_rows(paths.sparkSession, path_order=list(range(1, len(PATHS) + 1)), path=list(PATHS))
    n = F.coalesce("sessions", F.lit(0))
    return (
        order.join(counts, "path", "left").join(medians, "path", "left")
        .select(
            F.col("path_order").cast("long").alias("path_order"), "path", n.alias("sessions"),
            F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
            F.coalesce(pct(n, total), F.lit(0.0)).alias("share_pct"),
            "median_hours_since_cart", "median_sessions_since_cart",
        )
        .orderBy("path_order")
    )


def recovery_curve(carts: DataFrame, days: tuple[int, ...] = (1, 7, 14), checkout: bool | None = None) -> DataFrame:
    """Share of abandoned carts bought within N days, among carts with N days left; Wilson interval.

    One aggregate holds every day count; nothing is multiplied by the day list before it.
    """
    rows = carts if checkout is None else carts.where(F.col("reached_checkout") == F.lit(checkout))
    aggs = []
    for d in days:
        eligible = F.col("hours_left") >= d * 24
        aggs += [
            F.count_if(eligible).alias(f"m{d}"),
            F.count_if(eligible & (F.col("hours_to_next_purchase") <= d * 24)).alias(f"k{d}"),
        ]
    long = rows.agg(*aggs).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(d).cast("long").alias("days"), F.col(f"m{d}").alias("eligible_carts"),
                        F.col(f"k{d}").alias("recovered"),
                    )
                    for d in days
                ]
            )
        ).alias("r")
    ).select("r.*")
    lo, hi = wilson_ci("recovered", "eligible_carts")
    return long.select(
        "days", "eligible_carts", "recovered", pct("recovered", "eligible_carts").alias("recovered_pct"),
        lo.alias("ci_lo"), hi.alias("ci_hi"),
    ).orderBy("days")
