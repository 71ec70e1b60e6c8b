
from __future__ import annotations

import datetime as dt
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import statements
from sessionlens.functions import exprs
from sessionlens.functions.stats import diff_ci, wilson_ci
from sessionlens.model import MICROS_PER_SECOND, EventWindow
from sessionlens.operators import (
    catalog, channels, cohorts, funnel, inference, intervals, landing, paths, quality, revenue, sessions, sizing, sketches, star,
)
from sessionlens.operators.session_state import SessionTable
from sessionlens.plans.export import export_star_schema
from sessionlens.plans.study import Study, Thresholds
from sessionlens.sources import sinks
from sessionlens.sources.driver_tables import order_visits, shop_events
from sessionlens.sources.events import PARTITION, date_range, in_window, scan_estimate
from sessionlens.sources.footers import column_chunks, column_estimate
from sessionlens.sources.staging import scratch_path, stage
from sessionlens.sources.versions import read_published
from sessionlens.streaming.sessions import replay, stream_sessions, stream_steps

SHOP_WINDOW = EventWindow("20240101", "20240130")
ORDER_WINDOW = EventWindow("19950101", "20010801")
ONE_WEEK = EventWindow("20240108", "20240114")
FIRST_HALF = EventWindow("20240101", "20240115")
SECOND_HALF = EventWindow("20240116", "20240130")

# The test tables are small, so rows are kept from a lower volume on than in a real shop.
THRESHOLDS = Thresholds(
    landing_sessions=20, busy_week=5, inside_sessions=20, gap_share=0.8, gap_weeks=2, category_views=100, low_n=2
)

_studies: dict[tuple[str, str, str], Study] = {}


def _study(spark: SparkSession, sf_dir: str, kind: str) -> Study:
    """The study of one source, shared by all queries of a Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _studies:
        if kind == "shop":
            _studies[key] = Study(shop_events(spark, sf_dir), SHOP_WINDOW, THRESHOLDS)
        else:
            _studies[key] = Study(order_visits(spark, sf_dir), ORDER_WINDOW, THRESHOLDS, by_day=False)
    return _studies[key]


def shop(spark: SparkSession, sf_dir: str) -> Study:
    """Sessions, items and revenue: the `events` stream as a shop's export."""
    return _study(spark, sf_dir, "shop")


def visits(spark: SparkSession, sf_dir: str) -> Study:
    """Retention over years: `orders` as visits."""
    return _study(spark, sf_dir, "orders")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, as in the oracle."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def _counted(df: DataFrame, what: str, **columns) -> DataFrame:
    keys = [value.alias(name) for name, value in columns.items()]
    return df.groupBy(*keys).agg(F.count("*").alias(what))


def _labelled_items(s: Study, column, name: str) -> DataFrame:
    items = catalog.listing_items(s.events)
    return _counted(items, "items", raw_category=F.col("raw_category"), **{name: column("raw_category")})


def _params(s: Study) -> DataFrame:
    return s.raw.select(
        "event_timestamp", "user_pseudo_id", "event_name",
        exprs.param("ga_session_id").alias("ga_session_id"),
        exprs.param("medium", "string").alias("medium"),
        exprs.param("engagement_time_msec").alias("engagement_time_msec"),
        exprs.param("ga_session_number").alias("ga_session_number"),
        exprs.param("page_location", "string").alias("page_location"),
    )


def _urls(s: Study) -> DataFrame:
    url = exprs.param("page_location", "string")
    return _counted(s.raw, "events", url=url, page_path=exprs.page_path(url))


def _scan(s: Study) -> DataFrame:
    return in_window(s.events, ONE_WEEK).groupBy("event_name").agg(
        F.count("*").alias("events"), F.min("event_timestamp").alias("first_ts"), F.max("event_timestamp").alias("last_ts")
    )


def _estimate(s: Study) -> DataFrame:
    """A week's scan of three columns. Bytes of files do not show in SQL; the rows do, and that columns cost less than files."""
    files = s.files(ONE_WEEK)
    named = column_estimate(column_chunks(files), ["event_name", "event_timestamp", "user_pseudo_id"])
    cheaper = F.col("bytes").between(F.lit(1), F.col("_whole.bytes") - 1)
    return exprs.attach(named, scan_estimate(files), "_whole").select("column", "rows", cheaper.alias("cheaper"), "within_budget")


def _flat(s: Study) -> DataFrame:
    size = F.when(F.col("items").isNotNull(), exprs.items_count("items"))
    return s.events.withColumn("n_items", size).drop("items")


def _publish(s: Study) -> DataFrame:
    """Publish the device funnel over a version with one purchase more everywhere; the rows that made the difference, and the decision."""
    path = scratch_path(s.spark, "published")
    now = funnel.device_funnel(s.sessions).withColumn("generated_at", F.current_timestamp())
    sinks.publish_if_changed(now.withColumn("purchase", F.col("purchase") + 1), path)
    changes = sinks.changed_rows(now, read_published(s.spark, path), ("generated_at",))
    # compared before the new version is published
    changes = stage(changes, "changes")[0]
    return changes.withColumn("published", F.lit(sinks.publish_if_changed(now, path)))


def _session_days(s: Study) -> DataFrame:
    """Sessions loaded up to the last two days, which are then added one by one."""
    table = SessionTable(s.spark, scratch_path(s.spark, "session-days"), {"device_category": F.col("device_category")})
    last = s.window.last_day
    late = [last - dt.timedelta(days=1), last]
    table.load(s.events.where(F.col(PARTITION) < F.lit(late[0])))
    for when in late:
        table.put_day(s.events, when)
    return table.sessions().drop("landing_page", "session_date")


def _streamed(s: Study, build: Callable[..., DataFrame]) -> DataFrame:
    """The study's event files as a stream. Day files are not written in order, so events may be as late as the window is long."""
    lateness, gap = dt.timedelta(days=(s.window.last_day - s.window.first_day).days + 2), dt.timedelta(hours=12)
    end = dt.datetime.combine(s.window.last_day, dt.time()) + 2 * lateness
    return replay(s.spark, s.event_path, s.events.schema, lambda ev: build(ev, gap, lateness), end, files_per_batch=64).table


def _sketch_weeks(s: Study) -> DataFrame:
    """Weeks merged from daily sketches; SQL holds the exact figures, and that the estimates are within their bounds."""
    days = stage(sketches.daily_sketches(s.events, s.base), "sketches")[0]
    found = sketches.beside_exact(days, s.events, s.base, week=F.date_trunc("week", "day").cast("date"))
    return found.select(
        "week", "unique_users", "conversions", (F.col("users_error") <= sketches.WITHIN_USERS).alias("users_within"),
        (F.coalesce("rank_error", F.lit(0.0)) <= sketches.WITHIN_RANK).alias("median_within"),
    )


def _cart_views(s: Study) -> DataFrame:
    """Views of a user from a session's first cart until its purchase, or for a week without one."""
    until = F.coalesce("ts_p", F.col("ts_c") + 7 * 86_400 * MICROS_PER_SECOND)
    windows = s.base.where("ts_c IS NOT NULL").select("user_pseudo_id", "session_id", F.col("ts_c").alias("opens"), until.alias("closes"))
    views = s.events.where("event_name = 'view_item'").select("user_pseudo_id", "event_timestamp")
    found = intervals.interval_join(
        views, windows, ["user_pseudo_id"], "event_timestamp", "opens", "closes", materialise=s.materialise
    )
    return found.groupBy("user_pseudo_id", "session_id").agg(
        F.count("*").alias("views"), F.min("event_timestamp").alias("first_view_ts"), F.max("event_timestamp").alias("last_view_ts")
    )


def _window_counts(ev: DataFrame, window: EventWindow) -> DataFrame:
    return funnel.session_funnel(sessions.sessions(in_window(ev, window)))


def _wilson(s: Study) -> DataFrame:
    lo, hi = wilson_ci("purchase", "sessions")
    return s.country_counts.select("country", "sessions", "purchase", lo.alias("ci_lo"), hi.alias("ci_hi"))


def _diff(s: Study) -> DataFrame:
    d, lo, hi = diff_ci("view_item", "sessions", "_f.view_item", "_f.sessions")
    return exprs.attach(s.country_counts, s.funnel, "_f").select("country", d.alias("diff_pp"), lo.alias("ci_lo"), hi.alias("ci_hi"))


def _flagged(s: Study) -> DataFrame:
    """All listing pages flagged against the average over price bands."""
    rows = s.listing.select(
        "item_category", "viewing_sessions", "carting_sessions",
        exprs.pct("carting_sessions", "viewing_sessions").alias("atc_pct"),
    )
    return catalog.flag_categories(rows, catalog.site_average(s.bands))


def _bands_dim(s: Study) -> DataFrame:
    seen = s.bands.select("price_band", "viewing_sessions")
    return star.dim_price_band(s.spark).join(seen, "price_band", "left").fillna(0, ["viewing_sessions"])


def _star(s: Study) -> DataFrame:
    return export_star_schema(s, scratch_path(s.spark, "star"))


# name → (source study, builder)
_SHOP: dict[str, Callable[[Study], DataFrame]] = {
    "scan_events": _scan,
    "date_range": lambda s: date_range(s.files()),
    "scan_estimate": _estimate,
    "flatten_events": _flat,
    "write_star_schema": _star,
    "publish_if_changed": _publish,
    "param": _params,
    "page_path": _urls,
    "category_label": lambda s: _labelled_items(s, exprs.category_label, "item_category"),
    "parent_node": lambda s: _labelled_items(s, exprs.parent_node, "parent_node"),
    "price_band": lambda s: _counted(
        catalog.listing_items(s.events), "items", price=F.col("price"), price_band=exprs.price_band("price")
    ),
    "size_bucket": lambda s: _counted(
        s.sessions, "sessions", n_events=F.col("n_events"), size_bucket=exprs.size_bucket("n_events")
    ),
    "visitor_type": lambda s: _counted(
        s.sessions, "sessions", session_number=F.col("session_number"), visitor_type=exprs.visitor_type("session_number")
    ),
    "week_start": lambda s: _counted(
        s.events, "events", event_date=F.col("event_date"), week=exprs.week_start("event_date")
    ),
    "session_key": lambda s: s.sessions.select(
        "user_pseudo_id", "session_id", exprs.session_key("user_pseudo_id", "session_id").alias("session_key")
    ),
    "items_quality": lambda s: _counted(
        s.events, "events", event_name=F.col("event_name"), items=exprs.items_count("items"),
        carted=exprs.carted_items("items"),
    ),
    "is_shopping_page": lambda s: _counted(
        s.events, "events", page_path=F.col("page_path"), is_shopping_page=exprs.is_shopping_page("page_path")
    ),
    "p_label": lambda s: star.stats_tests(s.fct_sessions, s.materialise).select("test", exprs.p_label("p").alias("p_label")),
    "session_attrs": lambda s: sessions.session_attrs(s.events),
    "sessions": lambda s: sessions.sessions(
        s.events, event_dims={"device_category": F.col("device_category")}, revenue=True, attributes=True
    ),
    "session_days": _session_days,
    "stream_sessions": lambda s: sessions.funnel_sessions(_streamed(s, stream_sessions)).drop("landing_page", "session_date"),
    "stream_funnel": lambda s: funnel.session_funnel(_streamed(s, stream_steps)),
    "funnel": lambda s: funnel.funnel(
        s.sessions, group_by={"visitor": exprs.visitor_type("session_number")}, revenue=True
    ),
    "session_funnel": lambda s: funnel.session_funnel(s.sessions),
    "shoppers_funnel": lambda s: funnel.shoppers_funnel(s.base),
    "device_funnel": lambda s: funnel.device_funnel(s.sessions),
    "country_funnel": lambda s: funnel.country_funnel(s.sessions),
    "channel_funnel": lambda s: funnel.channel_funnel(s.sessions),
    "funnel_rates": lambda s: funnel.funnel_rates(s.funnel),
    "step_losses": lambda s: funnel.step_losses(s.funnel),
    "funnel_segments": lambda s: funnel.funnel_segments(s.sessions, THRESHOLDS.channel_share),
    "period_funnels": lambda s: funnel.period_funnels(s.events, SECOND_HALF, FIRST_HALF),
    "revenue_summary": lambda s: revenue.revenue_summary(s.sessions, s.materialise),
    "revenue_reconcile": lambda s: revenue.revenue_reconcile(s.revenue),
    "session_quality": lambda s: quality.session_quality(s.sessions, s.materialise),
    "untagged_profile": lambda s: quality.untagged_profile(s.quality),
    "untagged_overall": lambda s: quality.untagged_overall(s.quality),
    "sensitivity_funnel": lambda s: quality.sensitivity_funnel(s.quality),
    "new_vs_returning": lambda s: quality.new_vs_returning(s.quality),
    "event_inventory": lambda s: quality.event_inventory(s.events),
    "sketch_weeks": _sketch_weeks,
    "unique_users": lambda s: quality.unique_users(s.events),
    "session_start_check": lambda s: quality.session_start_check(s.events),
    "event_quality": lambda s: quality.event_quality(s.events),
    "event_quality_rates": lambda s: quality.event_quality_rates(quality.event_quality(s.events), s.convert),
    "time_to_convert": lambda s: revenue.time_to_convert(s.sessions, s.materialise),
    "channel_table": lambda s: channels.channel_table(s.channel_counts, THRESHOLDS.channel_share, low_n=THRESHOLDS.low_n),
    "medium_agreement": lambda s: channels.medium_agreement(s.channel_counts),
    "medium_crosstab": lambda s: channels.medium_crosstab(s.channel_counts),
    "device_table": lambda s: channels.device_table(s.device_counts),
    "device_steps": lambda s: channels.device_steps(s.device_counts),
    "channel_verdict": lambda s: channels.channel_verdict(s.channels),
    "segment_rows": lambda s: inference.segment_rows(s.country_counts, "country"),
    "segment_spread": lambda s: inference.segment_spread(s.country_counts, "country"),
    "landing_pages": lambda s: landing.landing_pages(s.sessions, THRESHOLDS.landing_sessions),
    "weak_landing_pages": lambda s: landing.weak_landing_pages(s.landing, s.funnel),
    "landing_diagnosis": lambda s: landing.landing_diagnosis(s.events, s.base, s.weak),
    "tracking_gaps": lambda s: s.gaps,
    "landing_verdict": lambda s: landing.landing_verdict(
        s.diagnosis, s.gaps, s.funnel, min_sessions=THRESHOLDS.inside_sessions
    ),
    "listing_pages": lambda s: catalog.listing_pages(s.events, s.cells),
    "listing_coverage": lambda s: catalog.listing_coverage(s.listing, THRESHOLDS.category_views),
    "category_overlap": lambda s: catalog.category_overlap(s.cells),
    "overlap_summary": lambda s: catalog.overlap_summary(catalog.category_overlap(s.cells)),
    "price_bands": lambda s: catalog.price_bands(s.events),
    "listing_levels": lambda s: catalog.listing_levels(s.listing),
    "site_average": lambda s: catalog.site_average(s.listing),
    "flag_categories": _flagged,
    "category_ranking": lambda s: catalog.category_ranking(s.listing, THRESHOLDS.category_views),
    "listing_other": lambda s: catalog.listing_other(s.listing, THRESHOLDS.category_views),
    "category_targets": lambda s: catalog.category_targets(s.ranking),
    "category_summary": lambda s: catalog.category_summary(s.ranking),
    "price_rank_corr": lambda s: catalog.price_rank_corr(s.ranking),
    "price_band_test": lambda s: catalog.price_band_test(s.bands),
    "user_sessions": lambda s: sessions.user_sessions(
        s.sessions.select(
            "user_pseudo_id", "session_id", "ts_s", "ts_v", "ts_c", "ts_k", "ts_p", "revenue", "s1", "s2", "s3", "s4", "s5"
        )
    ),
    "purchase_paths": lambda s: s.paths,
    "cart_recovery": lambda s: s.carts,
    "purchase_path_summary": lambda s: paths.purchase_path_summary(s.paths, s.materialise),
    "cart_views": _cart_views,
    "recovery_curve": lambda s: paths.recovery_curve(s.carts),
    "wilson_ci": _wilson,
    "diff_ci": _diff,
    "chi_square": lambda s: inference.chi_square(s.channel_counts, "view_item", "sessions", by=("first_touch_medium",)),
    "compare_periods": lambda s: inference.compare_periods(
        _window_counts(s.events, SECOND_HALF), _window_counts(s.events, FIRST_HALF)
    ),
    "stats_tests": lambda s: star.stats_tests(s.fct_sessions, s.materialise),
    "opportunity_lift": lambda s: sizing.opportunity_lift(s.totals, (5, 10)),
    "landing_sizing": lambda s: sizing.landing_sizing(s.weak, s.verdicts, s.totals),
    "cart_recovery_sizing": lambda s: sizing.cart_recovery_sizing(s.totals),
    "catalogue_sizing": lambda s: sizing.catalogue_sizing(s.ranking, s.totals),
    "priority_label": lambda s: sizing.priority_label(s.totals),
    "fct_sessions": lambda s: s.fct_sessions,
    "fct_session_listing": lambda s: star.fct_session_listing(s.events),
    "fct_session_price_band": lambda s: star.fct_session_price_band(s.events),
    "dim_price_band": _bands_dim,
    "dim_listing": lambda s: star.dim_listing(s.listing, THRESHOLDS.category_views),
    "landing_diagnosis_table": lambda s: star.landing_diagnosis_table(s.verdicts),
    "reconcile": lambda s: s.reconciliation(),
}

_VISITS: dict[str, Callable[[Study], DataFrame]] = {
    "cohorts": lambda v: cohorts.cohorts(v.events),
    "retention_matrix": lambda v: cohorts.retention_matrix(v.cohorts, v.window),
    "cohort_eligibility": lambda v: cohorts.cohort_eligibility(v.cohort_channels, v.window),
    "retention_averages": lambda v: cohorts.retention_averages(v.matrix, v.window),
    "retention_by_month": lambda v: cohorts.retention_by_month(v.matrix, v.window),
    "cohort_channel": lambda v: cohorts.cohort_channel(v.events, v.base),
    "retention_mix": lambda v: v.retention_mix,
    "mix_decomposition": lambda v: inference.mix_decomposition(v.peak, v.trough, "medium"),
    "channel_changes": lambda v: inference.channel_changes(v.peak, v.trough),
    "channels_fell": lambda v: inference.channels_fell(v.peak, v.trough),
    "dim_users": lambda v: star.dim_users(v.events),
    "fct_user_activity": lambda v: star.fct_user_activity(v.events),
}

_BOTH: dict[str, Callable[[Study, Study], DataFrame]] = {
    "reengagement_sizing": lambda s, v: sizing.reengagement_sizing(v.matrix, s.visitors, v.window),
    "recommendations": lambda s, v: s.recommendations(v),
    "findings": lambda s, v: sinks.findings(s.report_tables(v)),
    "findings_json": lambda s, v: sinks.findings_json(s.report_tables(v)),
}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the five-step session funnel with its rates, over the smallest tables."""
    study = shop(spark, "/root/testdata/sf0.001")
    return funnel.funnel_rates(funnel.session_funnel(study.sessions))


def _corpus() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the corpus operators and their pipeline; empty where those files have been taken away."""
    found, sql = {}, {}
    try:
        from sessionlens.llm import queries as operators

        found, sql = dict(operators.QUERIES), dict(operators.ORACLES)
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    except ModuleNotFoundError as missing:
        if missing.name not in ("sessionlens.llm", "corpus_pipeline"):
            raise
    return found, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name, build in _SHOP.items():
        out[name] = lambda spark, sf_dir, b=build: rounded(b(shop(spark, sf_dir)))
    for name, build in _VISITS.items():
        out[name] = lambda spark, sf_dir, b=build: rounded(b(visits(spark, sf_dir)))
    for name, build in _BOTH.items():
        out[name] = lambda spark, sf_dir, b=build: rounded(b(shop(spark, sf_dir), visits(spark, sf_dir)))
    return out | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    return statements.oracle_sql() | _corpus()[1]
