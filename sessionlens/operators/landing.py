"""Landing pages: funnel by page, weak pages, and why a page rarely shows a product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sessionlens.functions.exprs import (
    attach, is_shopping_page, null_safe_key, pct, round_half_even, week_start,
)
from sessionlens.model import NO_PAGE_VIEW

SESSION = ["user_pseudo_id", "session_id"]

# The diagnosis thresholds.
GAP_SHARE = 0.10  # a silent week's view rate is under this share of the page's working rate
WORKING_QUANTILE = 0.75  # the working rate is this quantile of the weekly rates
GAP_WEEKS = 3
BUSY_SESSIONS = 100
SCROLL_KEPT = 0.5  # behaviour is unchanged while scrolling keeps this share of its usual rate
INSIDE_LIFT_PP = 10


def landing_pages(ss: DataFrame, min_sessions: int = 100) -> DataFrame:
    """Funnel by the path of the session's first page_view; rare pages left out."""
    return (
        ss.where("s1")
        .groupBy(F.coalesce("landing_page", F.lit(NO_PAGE_VIEW)).alias("landing_page"))
        .agg(
            F.count("*").alias("sessions"), F.count_if("s2").alias("view_item"), F.count_if("s5").alias("purchase"),
            F.count_if(F.col("session_number") == 1).alias("new_sessions"),
            F.count_if(F.col("n_medium") == 0).alias("unattributed_sessions"),
        )
        .where(F.col("sessions") >= min_sessions)
        .orderBy(F.desc("sessions"), "landing_page")
    )


def weak_landing_pages(
    pages: DataFrame, totals: DataFrame, min_share: float = 1.0, min_gap_pp: float = 5.0
) -> DataFrame:
    """Shopping pages with real volume whose view rate sits well under the site's.

    `totals` is the one-row funnel: shares are of every session, not of the listed pages. At most
    100 / min_share pages can qualify, which bounds everything derived from this table.
    """
    gap = F.col("gap_pp")
    rows = attach(pages, totals.select("sessions", "view_item"), "_t")
    return (
        rows.where((F.col("landing_page") != NO_PAGE_VIEW) & is_shopping_page("landing_page"))
        .withColumns(
            {
                "share": F.coalesce(pct("sessions", "_t.sessions"), F.lit(0.0)),
                "view_pct": pct("view_item", "sessions"),
                "site_view_pct": pct("_t.view_item", "_t.sessions"),
            }
        )
        .withColumn("gap_pp", F.col("site_view_pct") - F.col("view_pct"))
        .where((F.col("share") >= min_share) & (gap >= min_gap_pp))
        .withColumn("extra_views", round_half_even(gap / 100 * F.col("sessions")).cast("long"))
        .drop("_t")
        .orderBy(F.desc("extra_views"), "landing_page")
    )


def landing_diagnosis(ev: DataFrame, base: DataFrame, pages: DataFrame) -> DataFrame:
    """Sessions that viewed each page, by week and entry (landed on it, or reached it from inside).

    `base` is `session_base(ev)`, which knows every session's landing page and tag. Only hits on the
    wanted pages are aggregated and matched to it. Whether the page list is sent to all tasks is left to
    Spark's check of its size; a written list has one.
    """
    wanted = pages.select(F.col("landing_page").alias("page_path")).distinct()
    on_page = (
        ev.where(F.col("session_id").isNotNull() & F.col("page_path").isNotNull())
        .select(*SESSION, "page_path", "event_name", "event_date", "eng_msec")
        .join(wanted, "page_path", "left_semi")
        .groupBy(null_safe_key("user_pseudo_id").alias("_u"), "session_id", "page_path")
        .agg(
            F.min(week_start("event_date")).alias("week"),
            F.bool_or(F.col("event_name") == "view_item").alias("viewed"),
            F.bool_or(F.col("event_name") == "scroll").alias("scrolled"),
            F.bool_or(F.col("event_name") == "page_view").alias("paged"),
            F.sum(F.coalesce("eng_msec", F.lit(0))).alias("eng_msec"),
        )
        .where("paged")
    )
    entries = base.select(
        null_safe_key("user_pseudo_id").alias("_u"), "session_id", "landing_page", (F.col("n_medium") > 0).alias("tagged")
    )
    return (
        on_page.join(entries, ["_u", "session_id"])
        .withColumn("entry", F.when(F.col("landing_page") == F.col("page_path"), "landed").otherwise("inside"))
        .groupBy("page_path", "week", "entry")
        .agg(
            F.count("*").alias("sessions"), F.count_if("viewed").alias("view_item_sessions"),
            F.count_if("scrolled").alias("scrolled_sessions"), F.count_if(~F.col("tagged")).alias("untagged_sessions"),
            # Whole milliseconds rounded to tenths: the same total in whatever order rows arrive.
            (F.floor((F.sum("eng_msec") + 50) / 100) / 10).alias("eng_s_total"),
        )
        .orderBy("page_path", "week", "entry")
    )


def tracking_gaps(
    diag: DataFrame, min_sessions: int = BUSY_SESSIONS, gap_share: float = GAP_SHARE,
    quantile: float = WORKING_QUANTILE, min_weeks: int = GAP_WEEKS,
) -> DataFrame:
    """Per page, the longest run of silent busy weeks (first on ties), if long enough.

    Runs are consecutive in the list of busy weeks, so a quiet week does not break one. Windows hold one
    row per page and week.
    """
    weekly = diag.groupBy("page_path", "week").agg(
        *[F.sum(c).alias(c) for c in ("sessions", "view_item_sessions", "scrolled_sessions")]
    )
    page = Window.partitionBy("page_path")
    busy = (
        weekly.where(F.col("sessions") >= min_sessions)
        .withColumn("rate", pct("view_item_sessions", "sessions"))
        .withColumn("working_rate", F.percentile("rate", F.lit(quantile)).over(page))
        .withColumn("busy_weeks", F.count("*").over(page))
        .where(F.col("busy_weeks") > min_weeks)
        .withColumn("silent", F.col("rate") < gap_share * F.col("working_rate"))
        .withColumn("place", F.row_number().over(page.orderBy("week")))
        .withColumn("silent_place", F.row_number().over(Window.partitionBy("page_path", "silent").orderBy("week")))
        .withColumn("island", F.when(F.col("silent"), F.col("place") - F.col("silent_place")))
    )
    longest = (
        busy.where("silent").groupBy("page_path", "island")
        .agg(F.count("*").alias("gap_weeks"), F.min("week").alias("gap_start"), F.max("week").alias("gap_end"))
        .groupBy("page_path")
        .agg(F.min(F.struct(-F.col("gap_weeks"), "gap_start", "gap_end", "island", "gap_weeks")).alias("g"))
        .where(F.col("g.gap_weeks") >= min_weeks)
        .select(F.col("page_path").alias("_p"), "g.*")
    )
    inside = F.coalesce(busy["island"] == longest["island"], F.lit(False))
    part = lambda col, keep: F.sum(F.when(keep, F.col(col)))
    return (
        busy.join(longest, busy["page_path"] == longest["_p"])
        .select("page_path", "gap_start", "gap_end", "gap_weeks", "working_rate", "sessions", "view_item_sessions",
                "scrolled_sessions", inside.alias("_in"))
        .groupBy("page_path", "gap_start", "gap_end", "gap_weeks", "working_rate")
        .agg(
            pct(part("view_item_sessions", F.col("_in")), part("sessions", F.col("_in"))).alias("rate_in"),
            pct(part("view_item_sessions", ~F.col("_in")), part("sessions", ~F.col("_in"))).alias("rate_out"),
            pct(part("scrolled_sessions", F.col("_in")), part("sessions", F.col("_in"))).alias("scroll_in"),
            pct(part("scrolled_sessions", ~F.col("_in")), part("sessions", ~F.col("_in"))).alias("scroll_out"),
            part("sessions", F.col("_in")).alias("sessions_in"),
        )
        .orderBy("page_path")
    )


def landing_verdict(
    diag: DataFrame, gaps: DataFrame, totals: DataFrame, scroll_kept: float = SCROLL_KEPT,
    inside_lift_pp: float = INSIDE_LIFT_PP, min_sessions: int = BUSY_SESSIONS,
) -> DataFrame:
    """tracking / page / entry traffic / unclear per page, with the rates the rule uses."""
    site = pct("_t.view_item", "_t.sessions")
    of = lambda entry, col: F.coalesce(F.sum(F.when(F.col("entry") == entry, F.col(col))), F.lit(0))
    rates = diag.groupBy("page_path").agg(
        of("landed", "sessions").alias("landed_sessions"), of("inside", "sessions").alias("inside_sessions"),
        pct(of("landed", "view_item_sessions"), of("landed", "sessions")).alias("landed_rate"),
        pct(of("inside", "view_item_sessions"), of("inside", "sessions")).alias("inside_rate"),
        pct(of("landed", "untagged_sessions"), of("landed", "sessions")).alias("landed_untagged_pct"),
        F.try_divide(of("landed", "eng_s_total"), of("landed", "sessions")).alias("landed_eng_s"),
        F.try_divide(of("inside", "eng_s_total"), of("inside", "sessions")).alias("inside_eng_s"),
    )
    has_gap = F.col("gap_weeks").isNotNull()
    enough_inside = F.col("inside_sessions") >= min_sessions
    verdict = (
        F.when(has_gap & (F.col("scroll_in") >= scroll_kept * F.col("scroll_out")), "tracking")
        .when(has_gap | (enough_inside & (F.col("inside_rate") < site / 2)), "page")
        .when(enough_inside & (F.col("inside_rate") >= F.col("landed_rate") + inside_lift_pp), "entry traffic")
        .otherwise("unclear")
    )
    return (
        attach(rates.join(gaps, "page_path", "left"), totals.select("sessions", "view_item"), "_t")
        .withColumn("verdict", verdict)
        .select(
            "page_path", "landed_sessions", "inside_sessions", "landed_rate", "inside_rate", "landed_untagged_pct",
            "landed_eng_s", "inside_eng_s", "gap_start", "gap_end", "gap_weeks", "working_rate", "scroll_in",
            "scroll_out", "verdict",
        )
        .orderBy("page_path")
    )
