"""Data-quality splits: tagging, visitors, event inventory, what events record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.exprs import (
    SIZE_BUCKETS, attach, carted_items, items_count, literal_rows, pct, ratio, size_bucket, visitor_type,
)
from sessionlens.functions.ranks import exact_quantiles
from sessionlens.functions.stats import chi2_sf, wilson_ci
from sessionlens.model import COUNT_COLUMNS
from sessionlens.operators.funnel import funnel_revenue, step_counts

CUT_KEYS = ["cut", "size_bucket", "dev", "attributed", "visitor"]


def session_quality(
    ss: DataFrame, materialise: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Funnel counts, revenue and exact medians by tagging, session length, device and visitor type.

    Counts come from grouping sets over one scan. The medians need every session once per cut, as two
    (measure, value) rows; only located bins of them are ever ranked. `materialise` as in
    `exact_quantiles`: with it no more than those rows is shuffled.
    """
    f = ss.where("s1").select(
        "s1", "s2", "s3", "s4", "s5", "revenue", "n_page_view", "engaged_s", "n_events",
        (F.col("n_medium") > 0).alias("attributed"),
        visitor_type("session_number").alias("visitor"),
        size_bucket("n_events").alias("size_bucket"),
        F.col("device_category").alias("dev"),
    )
    dims = CUT_KEYS[1:]
    sets = [["attributed"], ["size_bucket", "attributed"], ["dev", "attributed"], ["visitor"]]
    cut = (
        F.when(F.grouping("size_bucket") == 0, "size")
        .when(F.grouping("dev") == 0, "device")
        .when(F.grouping("visitor") == 0, "visitor")
        .otherwise("all")
    )
    counts = f.groupingSets(sets, *dims).agg(
        cut.alias("cut"), *step_counts(), funnel_revenue(),
        F.count_if(F.col("n_page_view") > 0).alias("with_page_view"),
    )
    no_text, no_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    one_cut = lambda name, **kept: F.struct(
        F.lit(name).alias("cut"),
        *[kept.get(d, no_flag if d == "attributed" else no_text).alias(d) for d in dims],
    )
    a, s, d, v = (F.col(c) for c in ("attributed", "size_bucket", "dev", "visitor"))
    cuts = F.array(
        one_cut("all", attributed=a), one_cut("size", size_bucket=s, attributed=a),
        one_cut("device", dev=d, attributed=a), one_cut("visitor", visitor=v),
    )
    measures = F.array(
        F.struct(F.lit("engaged_s").alias("measure"), F.col("engaged_s").alias("value")),
        F.struct(F.lit("n_events").alias("measure"), F.col("n_events").cast("double").alias("value")),
    )
    long = (
        f.select(F.explode(cuts).alias("k"), "engaged_s", "n_events")
        .select("k.*", F.explode(measures).alias("m"))
        .select(*CUT_KEYS, "m.measure", "m.value")
    )
    medians = (
        exact_quantiles(long, [*CUT_KEYS, "measure"], "value", 0.5, materialise=materialise)
        .groupBy(*CUT_KEYS)
        .agg(
            F.max(F.when(F.col("measure") == "engaged_s", F.col("q_cont"))).alias("median_engaged_s"),
            F.max(F.when(F.col("measure") == "n_events", F.col("q_disc"))).cast("long").alias("median_events"),
        )
    )
    same = [counts[c].eqNullSafe(medians[c]) for c in CUT_KEYS]
    return (
        counts.join(medians, same, "left")
        .select(
            *[counts[c] for c in CUT_KEYS], *COUNT_COLUMNS, "revenue", "with_page_view",
            "median_engaged_s", "median_events",
        )
        .orderBy(*CUT_KEYS)
    )


def _when_tagged(tagged: bool, col: str):
    return F.sum(F.when(F.col("attributed") == tagged, F.col(col)))


def untagged_profile(quality: DataFrame) -> DataFrame:
    """Untagged share and view rates at matched session length, buckets in order."""
    by_size = quality.where("cut = 'size'").groupBy("size_bucket").agg(
        _when_tagged(True, "sessions").alias("n_at"), _when_tagged(False, "sessions").alias("n_ua"),
        _when_tagged(True, "view_item").alias("v_at"), _when_tagged(False, "view_item").alias("v_ua"),
    )
    labels = [label for _, label in SIZE_BUCKETS]
    order = literal_rows(quality.sparkSession, bucket_order=list(range(1, len(labels) + 1)), bucket=labels)
    both = F.coalesce("n_at", F.lit(0)) + F.coalesce("n_ua", F.lit(0))
    return (
        order.join(by_size, F.col("bucket") == F.col("size_bucket"), "left")
        .select(
            F.col("bucket_order").cast("long").alias("bucket_order"), "bucket",
            both.alias("sessions"),
            pct(F.coalesce("n_ua", F.lit(0)), both).alias("ua_pct"),
            pct("v_ua", "n_ua").alias("view_ua"),
            pct("v_at", "n_at").alias("view_at"),
        )
        .orderBy("bucket_order")
    )


def untagged_overall(quality: DataFrame) -> DataFrame:
    """One row: size, view rates, medians and loss share of sessions without a medium on any event."""
    pick = lambda tagged, col: F.max(
        F.when((F.col("cut") == "all") & (F.col("attributed") == tagged), F.col(col))
    )
    overall = quality.agg(
        *[pick(False, c).alias(f"ua_{c}") for c in ("sessions", "view_item", "with_page_view", "median_engaged_s", "median_events")],
        *[pick(True, c).alias(f"at_{c}") for c in ("sessions", "view_item", "with_page_view", "median_engaged_s", "median_events")],
        F.sum(F.when(F.col("cut") == "all", F.col("sessions"))).alias("all_sessions"),
        F.sum(F.when(F.col("cut") == "all", F.col("view_item"))).alias("all_views"),
    )
    share = (
        quality.where("cut = 'device'").groupBy("dev")
        .agg(_when_tagged(False, "sessions").alias("u"), F.sum("sessions").alias("n"))
        .agg(F.min(pct("u", "n")).alias("lo"), F.max(pct("u", "n")).alias("hi"))
    )
    return attach(overall, share, "_dev").select(
        "ua_sessions", pct("ua_sessions", "all_sessions").alias("ua_share"),
        pct("ua_view_item", "ua_sessions").alias("ua_view_pct"),
        pct("at_view_item", "at_sessions").alias("at_view_pct"),
        pct("ua_with_page_view", "ua_sessions").alias("ua_pv_pct"),
        pct("at_with_page_view", "at_sessions").alias("at_pv_pct"),
        "ua_median_engaged_s", "at_median_engaged_s", "ua_median_events", "at_median_events",
        pct(F.col("ua_sessions") - F.col("ua_view_item"), F.col("all_sessions") - F.col("all_views")).alias("ua_lost_share"),
        F.col("_dev.lo").alias("ua_device_min_pct"), F.col("_dev.hi").alias("ua_device_max_pct"),
    )


def _rates():
    return [
        pct("view_item", "sessions").alias("view_pct"),
        pct("add_to_cart", "view_item").alias("view_to_cart"),
        pct("begin_checkout", "add_to_cart").alias("cart_to_checkout"),
        pct("purchase", "begin_checkout").alias("checkout_to_purchase"),
        pct("purchase", "sessions").alias("cvr"),
        ratio("revenue", "sessions").alias("rev_per_session"),
    ]


def sensitivity_funnel(quality: DataFrame) -> DataFrame:
    """Rates over all sessions against tagged sessions only."""
    overall = quality.where("cut = 'all'")
    sums = [F.sum(c).alias(c) for c in (*COUNT_COLUMNS, "revenue")]
    everything = overall.agg(*sums).select(F.lit("all sessions").alias("basis"), "sessions", *_rates())
    tagged = overall.where("attributed").agg(*sums).select(
        F.lit("excluding untagged").alias("basis"), "sessions", *_rates()
    )
    return everything.unionByName(tagged).orderBy("basis")


def new_vs_returning(quality: DataFrame) -> DataFrame:
    """New and returning sessions: rates, interval, purchase-rate ratio and its chi-square test."""
    vis = quality.where("cut = 'visitor' AND visitor IN ('new', 'returning')")
    both = vis.agg(
        *[
            F.max(F.when(F.col("visitor") == v, F.col(c))).cast("double").alias(f"{v}_{c}")
            for v in ("new", "returning") for c in ("sessions", "purchase")
        ]
    )
    n1, k1, n2, k2 = (F.col(c) for c in ("new_sessions", "new_purchase", "returning_sessions", "returning_purchase"))
    p = (k1 + k2) / (n1 + n2)
    chi2 = F.try_divide(F.pow(k1 - n1 * p, 2), n1 * p * (1 - p)) + F.try_divide(F.pow(k2 - n2 * p, 2), n2 * p * (1 - p))
    test = both.select(
        F.try_divide(k2 / n2, k1 / n1).alias("cvr_ratio"), chi2.alias("chi2"),
        F.sqrt(chi2 / (n1 + n2)).alias("cramers_v"),
    )
    lo, hi = wilson_ci("purchase", "sessions")
    return attach(vis, test, "_t").select(
        "visitor", "sessions", "purchase", *_rates(), lo.alias("ci_lo"), hi.alias("ci_hi"),
        "_t.cvr_ratio", "_t.chi2", chi2_sf("_t.chi2", F.lit(1)).alias("p"), "_t.cramers_v",
    ).orderBy("visitor")


def event_inventory(ev: DataFrame) -> DataFrame:
    """Events and distinct users per event name."""
    return (
        ev.groupBy("event_name")
        .agg(F.count("*").alias("event_count"), F.count_distinct("user_pseudo_id").alias("unique_users"))
        .orderBy(F.desc("event_count"), "event_name")
    )


def unique_users(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("event_name") == "session_start").agg(
        F.count_distinct("user_pseudo_id").alias("unique_users")
    )


def session_start_check(ev: DataFrame) -> DataFrame:
    """Why session_start events outnumber sessions: missing ids, repeats, how far apart."""
    starts = ev.where(F.col("event_name") == "session_start")
    has_ids = F.col("session_id").isNotNull() & F.col("user_pseudo_id").isNotNull()
    # Identical timestamps collapse before the session grouping, so distinct needs no second pass.
    per_session = (
        starts.where(has_ids)
        .groupBy("user_pseudo_id", "session_id", "event_timestamp").agg(F.count("*").alias("c"))
        .groupBy("user_pseudo_id", "session_id")
        .agg(
            F.sum("c").alias("n"), F.count("*").alias("n_ts"),
            ((F.max("event_timestamp") - F.min("event_timestamp")) / F.lit(1e6)).alias("span_s"),
        )
    )
    repeated = F.col("n") > 1
    summary = per_session.agg(
        F.count("*").alias("distinct_sessions"),
        F.count_if(repeated).alias("sessions_with_repeat_start"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeat_start_events"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_starts_in_one_session"),
        F.count_if(repeated & (F.col("n_ts") < F.col("n"))).alias("repeats_with_identical_timestamp"),
        F.max(F.when(repeated, F.col("span_s"))).alias("max_seconds_between_repeats"),
    )
    events = starts.agg(F.count("*").alias("n"), F.count_if(~has_ids).alias("bad"))
    return attach(summary, events, "_e").select(
        F.col("_e.n").alias("session_start_events"), F.col("_e.bad").alias("events_without_ids"), *summary.columns
    )


def event_quality(ev: DataFrame) -> DataFrame:
    """What view_item and add_to_cart record: items per event, and events with exactly one carted item."""
    n = items_count("items")
    return (
        ev.where(F.col("event_name").isin("view_item", "add_to_cart"))
        .groupBy("event_name")
        .agg(
            F.count("*").alias("events"),
            F.round(F.avg(n), 1).alias("avg_items"),
            F.count_if(n > 1).alias("multi_item_events"),
            F.count_if(F.coalesce(n, F.lit(0)) == 0).alias("no_item_events"),
            F.count_if(carted_items("items") == 1).alias("one_carted_item_events"),
        )
        .orderBy(F.desc("event_name"))
    )


def event_quality_rates(eq: DataFrame, ttc: DataFrame) -> DataFrame:
    """Shares of list-sized, empty and single-cart events, and carts stamped with the view's timestamp."""
    of = lambda event, col: F.max(F.when(F.col("event_name") == event, F.col(col)))
    row = eq.agg(
        *[
            of(event, c).alias(f"{short}_{c}")
            for event, short in (("view_item", "vi"), ("add_to_cart", "atc"))
            for c in ("events", "avg_items", "multi_item_events", "no_item_events", "one_carted_item_events")
        ]
    )
    t = F.col("_t")
    return attach(row, ttc, "_t").select(
        F.col("vi_avg_items"), pct("vi_multi_item_events", "vi_events").alias("vi_multi_pct"),
        pct("vi_no_item_events", "vi_events").alias("vi_no_item_pct"),
        F.col("atc_avg_items"), pct("atc_one_carted_item_events", "atc_events").alias("atc_one_pct"),
        F.coalesce(pct(t["cart_same_ts_as_view"], t["carting_sessions"]), F.lit(0.0)).alias("cart_same_ts_pct"),
        t["cart_within_1s_after_view"].alias("cart_within_1s_after_view"),
        t["cart_before_or_without_view"].alias("cart_before_or_without_view"),
        pct(t["converting_same_ts"], t["converting_sessions"]).alias("conv_same_ts_pct"),
    )
