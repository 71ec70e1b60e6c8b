"""Row-level export tables and their reconciliation with the funnel.

Row-level tables are returned unsorted: a global sort of every session would be a second full shuffle.
Their natural sort keys are in EXPORT_ORDER for consumers that want one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlens.functions.exprs import (
    PRICE_BANDS, attach, literal_rows, scalars, session_key, visitor_type,
)
from sessionlens.model import COUNT_COLUMNS, MICROS_PER_MINUTE, NO_PAGE_VIEW, NOT_SET
from sessionlens.operators.catalog import listing_levels, session_listing_steps, session_price_band_steps
from sessionlens.operators.cohorts import user_activity, user_cohorts
from sessionlens.operators.inference import chi_square

EXPORT_ORDER = {
    "fct_sessions": ("session_key",),
    "fct_session_listing": ("session_key", "item_category"),
    "fct_session_price_band": ("session_key", "price_band"),
    "dim_users": ("user_pseudo_id",),
    "fct_user_activity": ("user_pseudo_id", "activity_week"),
}


def fct_sessions(ss: DataFrame, min_share: float = 1.0) -> DataFrame:
    """One row per funnel session with its attributes, channel group and step flags."""
    rows = ss.where("s1").withColumn("channel", F.coalesce("session_medium", F.lit(NOT_SET)))
    by_channel = rows.groupBy("channel").agg(F.count("*").alias("n"))
    total = scalars(by_channel.agg(F.sum("n").alias("n")))["n"]
    # At most 100 / min_share channels are large, so their names fit one array whatever the data.
    named = F.when(F.col("n") / total >= F.lit(min_share / 100), F.col("channel"))
    sizes = by_channel.agg(
        F.collect_set(named).alias("large"), (F.count("*") - F.count(named)).alias("n_small")
    )
    is_small, n_small = ~F.array_contains("_c.large", F.col("channel")), F.col("_c.n_small")
    pooled = F.concat(F.lit("other ("), n_small.cast("string"), F.lit(" small channels)"))
    return attach(rows, sizes, "_c").select(
        session_key("user_pseudo_id", "session_id").alias("session_key"), "user_pseudo_id", "session_date",
        "device_category", "channel",
        F.when(is_small & (n_small > 1), pooled).otherwise(F.col("channel")).alias("channel_group"),
        F.coalesce("first_touch_medium", F.lit(NOT_SET)).alias("first_touch_medium"),
        F.coalesce("country", F.lit(NOT_SET)).alias("country"),
        visitor_type("session_number").alias("visitor_type"),
        F.coalesce("landing_page", F.lit(NO_PAGE_VIEW)).alias("landing_page"),
        (F.col("n_medium") == 0).alias("unattributed"), "n_events",
        F.col("s2").alias("saw_product"), F.col("s3").alias("added_to_cart"), F.col("s4").alias("began_checkout"),
        F.col("s5").alias("purchased"), F.col("ts_p").isNotNull().alias("purchased_any_order"),
        F.when(F.col("s5"), F.coalesce("revenue", F.lit(0.0))).otherwise(0.0).alias("revenue"),
        F.when(F.col("s5"), (F.col("ts_p") - F.col("ts_s")) / F.lit(MICROS_PER_MINUTE)).alias("minutes_to_purchase"),
    )


def _seen(steps: DataFrame, key: str) -> DataFrame:
    carted = F.coalesce(F.col("ts_last_cart") >= F.col("ts_first_view"), F.lit(False))
    return steps.where(F.col("ts_first_view").isNotNull()).select(
        session_key("user_pseudo_id", "session_id").alias("session_key"), key, carted.alias("carted_after_view")
    )


def fct_session_listing(ev: DataFrame) -> DataFrame:
    """One row per session and listing page it saw."""
    return _seen(session_listing_steps(ev), "item_category")


def fct_session_price_band(ev: DataFrame) -> DataFrame:
    """One row per session and price band it saw."""
    return _seen(session_price_band_steps(ev), "price_band")


def dim_users(ev: DataFrame) -> DataFrame:
    return user_cohorts(ev)


def fct_user_activity(ev: DataFrame) -> DataFrame:
    return user_activity(ev)


def dim_price_band(spark: SparkSession) -> DataFrame:
    labels = [label for _, label in PRICE_BANDS]
    dim = literal_rows(spark, price_band=labels, band_order=list(range(1, len(labels) + 1)))
    return dim.withColumn("band_order", F.col("band_order").cast("long")).orderBy("band_order")


def dim_listing(lp: DataFrame, min_views: int = 500) -> DataFrame:
    """Level of every listing page, and whether it is ranked."""
    ranked = (
        (F.col("level") == "product type") & (F.col("item_category") != NOT_SET) & (F.col("viewing_sessions") >= min_views)
    )
    return listing_levels(lp).select(
        "item_category", "parent_node", "n_source_labels", "source_labels", "median_price", "level", ranked.alias("ranked")
    ).orderBy("item_category")


def landing_diagnosis_table(verdicts: DataFrame) -> DataFrame:
    """Verdict per weak page; a gap ends on the Sunday of its last week."""
    return verdicts.select(
        F.col("page_path").alias("landing_page"), F.col("verdict").alias("diagnosis"),
        F.col("landed_rate").alias("landed_rate_pct"), F.col("inside_rate").alias("inside_rate_pct"),
        "landed_untagged_pct", F.col("gap_start").alias("gap_from"), F.date_add("gap_end", 6).alias("gap_to"),
    ).orderBy("landing_page")


def stats_tests(
    fct: DataFrame, materialise: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Three chi-square tests over the exported sessions.

    The tests read the counted segments twice; `materialise` writes that small table in between.
    """
    named = ~(F.col("channel_group").startswith("other (") | F.col("channel_group").startswith(NOT_SET))
    known = F.col("visitor_type").isin("new", "returning")
    entry = lambda test, segment, flag, keep=F.lit(True): F.struct(
        F.lit(test).alias("test"), F.col(segment).alias("segment"), F.col(flag).alias("flag"), keep.alias("keep")
    )
    # One scan: each session enters the table of every test it belongs to.
    tables = F.array(
        entry("device × purchase", "device_category", "purchased", F.col("device_category").isNotNull()),
        entry("channel × saw a product (named channels)", "channel_group", "saw_product", F.coalesce(named, F.lit(False))),
        entry("new vs returning × purchase", "visitor_type", "purchased", known),
    )
    counted = (
        fct.select(F.explode(tables).alias("t")).select("t.*").where("keep")
        .groupBy("test", "segment")
        .agg(F.count("*").alias("n"), F.count_if("flag").alias("k"))
    )
    counted = counted if materialise is None else materialise(counted)
    return chi_square(counted, "k", "n", by=("test",)).orderBy("test")


def reconcile(fct: DataFrame, funnel: DataFrame, channels: DataFrame | None = None,
              quality: DataFrame | None = None, revenue: DataFrame | None = None) -> DataFrame:
    """One row per check: the exported sessions against the funnel, and the splits that must add up."""
    flags = ("saw_product", "added_to_cart", "began_checkout", "purchased")
    actual = fct.agg(
        F.count("*").alias("sessions"),
        *[F.count_if(flag).alias(step) for flag, step in zip(flags, COUNT_COLUMNS[1:])],
    )
    f = F.col("_f")
    check = lambda name, got, want: F.struct(F.lit(name).alias("check"), got.cast("long").alias("actual"), want.cast("long").alias("expected"))
    rows = [check(c, F.col(c), f[c]) for c in COUNT_COLUMNS]
    if channels is not None:
        rows.append(check("channel sessions", scalars(channels.agg(F.sum("sessions").alias("n")))["n"], f["sessions"]))
    if quality is not None:
        q = quality.where("cut = 'all'").agg(F.sum("sessions").alias("n"))
        rows.append(check("quality sessions", scalars(q)["n"], f["sessions"]))
    if revenue is not None:
        rows.append(check("revenue purchases", scalars(revenue.select("purchasing_sessions"))["purchasing_sessions"], f["purchase"]))
    return attach(actual, funnel, "_f").select(F.explode(F.array(*rows)).alias("r")).select(
        "r.*", F.col("r.actual").eqNullSafe(F.col("r.expected")).alias("ok")
    )


def require_reconciled(checks: DataFrame) -> None:
    """Raise on any mismatch (the table has a handful of rows)."""
    bad = [r for r in checks.where(~F.col("ok")).collect()]
    if bad:
        detail = ", ".join(f"{r['check']}: {r['actual']} != {r['expected']}" for r in bad)
        raise RuntimeError(f"exported sessions do not reconcile with the funnel: {detail}")
