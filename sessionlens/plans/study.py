"""A study: every operator over one event table, sharing the written flat and session tables.

The flat events and the session table are each computed once and written; twenty operators then read a
few columns of the session table instead of aggregating the raw events again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlens.model import EventWindow
from sessionlens.operators import (
    catalog, channels, cohorts, funnel, inference, landing, paths, quality, revenue, sessions, sizing, star,
)
from sessionlens.sources.events import PARTITION, event_files, flatten_events, in_window
from sessionlens.sources.staging import stage


@dataclass(frozen=True)
class Thresholds:
    """Volumes below which a row is left out; the defaults are those of a large shop."""

    landing_sessions: int = 100
    landing_share: float = 1.0
    landing_gap_pp: float = 5.0
    busy_week: int = 100
    inside_sessions: int = 100
    gap_share: float = 0.10
    gap_weeks: int = 3
    category_views: int = 500
    channel_share: float = 1.0
    low_n: int = 30


class Study:
    """Lazily built results over nested events `raw` (any DataFrame of the canonical schema)."""

    def __init__(
        self,
        raw: DataFrame,
        window: EventWindow,
        thresholds: Thresholds = Thresholds(),
        staged: bool = True,
        by_day: bool = True,
        day_aligned: bool = False,
        previous: EventWindow | None = None,
    ):
        """Only the window's days of `raw` are studied; `previous` is the period that its last month is compared with.

        `by_day` writes the flat events in day folders, worth it when a day fills a file.

        `day_aligned` says `raw` is read from day folders, so writing them again needs no shuffle.
        """
        self.previous = window.versus(previous)
        self.source, self.raw, self.window, self.thresholds = raw, in_window(raw, window), window, thresholds
        self.staged, self.by_day, self.day_aligned = staged, by_day, day_aligned

    @property
    def spark(self) -> SparkSession:
        return self.raw.sparkSession

    # shared tables ------------------------------------------------------------

    @cached_property
    def _events(self) -> tuple[DataFrame, str | None]:
        flat = flatten_events(self.raw)
        if not self.staged:
            return flat, None
        day = PARTITION if self.by_day else None
        return stage(flat, "events", day, sort_by="event_name", aligned=self.day_aligned)

    @property
    def events(self) -> DataFrame:
        return self._events[0]

    def files(self, window: EventWindow | None = None) -> DataFrame:
        """Listing of the written event files."""
        return event_files(self.spark, self.event_path, window)

    @property
    def event_path(self) -> str:
        """Folder of the written event files."""
        if self._events[1] is None:
            raise ValueError("an unstaged study has no event files")
        return self._events[1]

    @cached_property
    def base(self) -> DataFrame:
        table = sessions.session_base(self.events)
        return stage(table, "sessions")[0] if self.staged else table

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions.funnel_sessions(self.base)

    @cached_property
    def user_sessions(self) -> DataFrame:
        return sessions.user_sessions(self.sessions)

    @cached_property
    def intent_sessions(self) -> DataFrame:
        """User-ordered sessions with a cart or a purchase, all that paths and recovery look at."""
        keep = F.col("ts_c").isNotNull() | F.col("ts_p").isNotNull()
        table = self.user_sessions.where(keep).select(
            "ts_c", "ts_k", "ts_p", "s5", "revenue", "rn", "prev_cart_ts", "prev_cart_rn", "next_purchase_ts", "window_end_ts"
        )
        return stage(table, "intent-sessions")[0] if self.staged else table

    @cached_property
    def periods(self) -> DataFrame | None:
        """The funnel of the window's last month and of the period before that it is compared with; None without one."""
        if self.previous is None:
            return None
        now = self.window.last_month()
        rows = in_window(self.source, now).union(in_window(self.source, self.previous))
        return self._small(funnel.period_funnels(flatten_events(rows), now, self.previous), "periods")

    def compared_periods(self) -> DataFrame | None:
        """Change of the five funnel rates between the two periods."""
        if self.periods is None:
            return None
        of = lambda name: self.periods.where(F.col("period") == name)
        return inference.compare_periods(of("current"), of("previous"))

    # report tables ------------------------------------------------------------

    def _small(self, table: DataFrame, name: str) -> DataFrame:
        """An aggregated table several reports build on, written once."""
        return stage(table, name)[0] if self.staged else table

    @property
    def materialise(self):
        """Writes a small table and reads it back with a known size; None in an unstaged study."""
        return (lambda table: stage(table, "step")[0]) if self.staged else None

    @cached_property
    def funnel(self) -> DataFrame:
        return self._small(funnel.session_funnel(self.sessions), "funnel")

    @cached_property
    def revenue(self) -> DataFrame:
        return self._small(revenue.revenue_summary(self.sessions, self.materialise), "revenue")

    @cached_property
    def quality(self) -> DataFrame:
        return self._small(quality.session_quality(self.sessions, self.materialise), "quality")

    @cached_property
    def convert(self) -> DataFrame:
        return self._small(revenue.time_to_convert(self.sessions, self.materialise), "convert")

    @cached_property
    def channel_counts(self) -> DataFrame:
        return self._small(funnel.channel_funnel(self.sessions), "channel-counts")

    @cached_property
    def device_counts(self) -> DataFrame:
        return self._small(funnel.device_funnel(self.sessions), "device-counts")

    @cached_property
    def country_counts(self) -> DataFrame:
        return self._small(funnel.country_funnel(self.sessions), "country-counts")

    @cached_property
    def channels(self) -> DataFrame:
        t = self.thresholds
        table = channels.channel_table(self.channel_counts, t.channel_share, low_n=t.low_n)
        return self._small(table, "channels")

    @cached_property
    def landing(self) -> DataFrame:
        return self._small(landing.landing_pages(self.sessions, self.thresholds.landing_sessions), "landing")

    @cached_property
    def weak(self) -> DataFrame:
        t = self.thresholds
        table = landing.weak_landing_pages(self.landing, self.funnel, t.landing_share, t.landing_gap_pp)
        return self._small(table, "weak")

    @cached_property
    def diagnosis(self) -> DataFrame:
        diag = landing.landing_diagnosis(self.events, self.base, self.weak)
        return self._small(diag, "diagnosis")

    @cached_property
    def gaps(self) -> DataFrame:
        t = self.thresholds
        return landing.tracking_gaps(self.diagnosis, t.busy_week, t.gap_share, min_weeks=t.gap_weeks)

    @cached_property
    def verdicts(self) -> DataFrame:
        table = landing.landing_verdict(
            self.diagnosis, self.gaps, self.funnel, min_sessions=self.thresholds.inside_sessions
        )
        return self._small(table, "verdicts")

    @cached_property
    def cells(self) -> DataFrame:
        return self._small(catalog.item_cells(self.events), "item-cells")

    @cached_property
    def listing(self) -> DataFrame:
        return self._small(catalog.listing_pages(self.events, self.cells), "listing")

    @cached_property
    def ranking(self) -> DataFrame:
        return self._small(catalog.category_ranking(self.listing, self.thresholds.category_views), "ranking")

    @cached_property
    def bands(self) -> DataFrame:
        return self._small(catalog.price_bands(self.events), "bands")

    @cached_property
    def user_weeks(self) -> DataFrame:
        """Users with their first start and active weeks, which cohorts and their channels share."""
        table = cohorts.user_weeks(self.events)
        return stage(table, "user-weeks")[0] if self.staged else table

    @cached_property
    def cohorts(self) -> DataFrame:
        return self._small(cohorts.cohorts(self.events, self.user_weeks), "cohorts")

    @cached_property
    def matrix(self) -> DataFrame:
        return self._small(cohorts.retention_matrix(self.cohorts, self.window), "matrix")

    @cached_property
    def months(self) -> DataFrame:
        return self._small(cohorts.retention_by_month(self.matrix, self.window), "months")

    @cached_property
    def cohort_channels(self) -> DataFrame:
        return self._small(cohorts.cohort_channel(self.events, self.base, self.user_weeks), "cohort-channels")

    @cached_property
    def peak(self) -> DataFrame:
        return cohorts.month_channels(self.cohort_channels, self.months, "peak", self.window)

    @cached_property
    def trough(self) -> DataFrame:
        return cohorts.month_channels(self.cohort_channels, self.months, "trough", self.window)

    @cached_property
    def retention_mix(self) -> DataFrame:
        return inference.mix_decomposition(self.peak, self.trough, "medium")

    @cached_property
    def paths(self) -> DataFrame:
        return paths.purchase_paths(self.intent_sessions)

    @cached_property
    def carts(self) -> DataFrame:
        return paths.cart_recovery(self.intent_sessions)

    @cached_property
    def totals(self) -> DataFrame:
        return self._small(sizing.totals(self.funnel, self.revenue), "totals")

    @cached_property
    def visitors(self) -> DataFrame:
        return self._small(quality.new_vs_returning(self.quality), "visitors")

    @cached_property
    def fct_sessions(self) -> DataFrame:
        return star.fct_sessions(self.sessions, self.thresholds.channel_share)

    def recommendations(self, retention: "Study | None" = None) -> DataFrame:
        """The sized actions; retention may be studied on another event table."""
        r = retention or self
        return sizing.recommendations(
            sizing.landing_sizing(self.weak, self.verdicts, self.totals),
            sizing.cart_recovery_sizing(self.totals),
            sizing.reengagement_sizing(r.matrix, self.visitors, r.window),
            sizing.catalogue_sizing(self.ranking, self.totals),
        )

    # exports ------------------------------------------------------------------

    def star_tables(self) -> dict[str, DataFrame]:
        """Every export table by name."""
        t = self.thresholds
        return {
            "fct_sessions": self.fct_sessions,
            "fct_session_listing": star.fct_session_listing(self.events),
            "fct_session_price_band": star.fct_session_price_band(self.events),
            "dim_users": star.dim_users(self.events),
            "fct_user_activity": star.fct_user_activity(self.events),
            "agg_cohort_channel": cohorts.cohort_eligibility(self.cohort_channels, self.window),
            "dim_price_band": star.dim_price_band(self.spark),
            "dim_listing": star.dim_listing(self.listing, t.category_views),
            "landing_diagnosis": star.landing_diagnosis_table(self.verdicts),
            "stats_tests": star.stats_tests(self.fct_sessions, self.materialise),
        }

    def reconciliation(self) -> DataFrame:
        return star.reconcile(self.fct_sessions, self.funnel, self.channel_counts, self.quality, self.revenue)

    def report_tables(self, retention: "Study | None" = None) -> dict[str, DataFrame]:
        """The tables whose numbers and verdicts the findings carry."""
        r = retention or self
        t = self.thresholds
        return {
            "session_funnel": funnel.funnel_rates(self.funnel),
            "step_losses": funnel.step_losses(self.funnel),
            "revenue": self.revenue,
            "revenue_reconcile": revenue.revenue_reconcile(self.revenue),
            "time_to_convert": self.convert,
            "devices": channels.device_table(self.device_counts),
            "shoppers_funnel": funnel.shoppers_funnel(self.base),
            "retention": cohorts.retention_averages(r.matrix, r.window),
            "retention_months": r.months,
            "retention_mix": r.retention_mix,
            "channels": self.channels,
            "channel_verdict": channels.channel_verdict(self.channels),
            "categories": self.ranking,
            "category_summary": catalog.category_summary(self.ranking),
            "other_listings": catalog.listing_other(self.listing, t.category_views),
            "price_bands": catalog.price_band_test(self.bands),
            "price_correlation": catalog.price_rank_corr(self.ranking),
            "landing_pages": self.weak,
            "landing_verdicts": self.verdicts,
            "untagged": quality.untagged_overall(self.quality),
            "visitors": self.visitors,
            "recommendations": self.recommendations(r),
            "priority": sizing.priority_label(self.totals),
            "segments": funnel.funnel_segments(self.sessions, t.channel_share),
            "events": quality.event_inventory(self.events),
            "unique_users": quality.unique_users(self.events),
            "event_quality": quality.event_quality_rates(quality.event_quality(self.events), self.convert),
            "session_starts": quality.session_start_check(self.events),
            "untagged_profile": quality.untagged_profile(self.quality),
            "sensitivity": quality.sensitivity_funnel(self.quality),
            "medium_agreement": channels.medium_agreement(self.channel_counts),
            "device_steps": channels.device_steps(self.device_counts),
            "tracking_gaps": self.gaps,
            "listing_coverage": catalog.listing_coverage(self.listing, t.category_views),
            "product_overlap": catalog.overlap_summary(catalog.category_overlap(self.cells)),
            "channel_changes": inference.channel_changes(r.peak, r.trough),
            "channels_fell": inference.channels_fell(r.peak, r.trough),
            "purchase_paths": paths.purchase_path_summary(self.paths, self.materialise),
            "cart_recovery": paths.recovery_curve(self.carts),
            "tests": star.stats_tests(self.fct_sessions, self.materialise),
            **({"periods": self.periods, "period_changes": self.compared_periods()} if self.previous else {}),
        }
