"""Tests and comparisons over aggregated counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens.functions.exprs import attach, pct, scalars
from sessionlens.functions.stats import chi2_sf, diff_ci
from sessionlens.model import NOT_SET

# The five compared funnel rates (label, numerator, denominator).
FUNNEL_RATES = (
    ("Saw a product", "view_item", "sessions"),
    ("Saw → carted", "add_to_cart", "view_item"),
    ("Cart → checkout", "begin_checkout", "add_to_cart"),
    ("Checkout → purchase", "purchase", "begin_checkout"),
    ("Session → purchase", "purchase", "sessions"),
)
DRIVER_PP = 10
BORDERLINE_PP = 7


def chi_square(df: DataFrame, successes: str, totals: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Is the success rate the same in every row? One test per `by` key.

    chi2, dof (rows − 1), p and Cramér's V, without continuity correction; chi2, p and V are null where
    the test is undefined (no or only successes, or an empty row).
    """
    k, n = F.col(successes).cast("double"), F.col(totals).cast("double")
    pooled = df.groupBy(*by).agg(
        F.sum(k).alias("_k"), F.sum(n).alias("_n"), F.min(n).alias("_least")
    )
    if by:
        rows = df.join(pooled, list(by))
    else:
        rows = attach(df, pooled, "_t").select(*df.columns, "_t.*")
    share = F.col("_k") / F.col("_n")
    testable = (F.col("_least") > 0) & (F.col("_k") > 0) & (F.col("_k") < F.col("_n"))
    cell = F.when(testable, F.pow(k - n * share, 2) / (n * share * (1 - share)))
    out = rows.groupBy(*by).agg(
        F.sum(cell).alias("chi2"), (F.count("*") - 1).alias("dof"), F.max("_n").alias("_total")
    )
    return out.select(
        *by, "chi2", "dof", chi2_sf("chi2", "dof").alias("p"),
        F.sqrt(F.col("chi2") / F.col("_total")).alias("cramers_v"),
    )


def spread_verdict(spread: Column, driver_pp: float = DRIVER_PP, borderline_pp: float = BORDERLINE_PP) -> Column:
    return (
        F.when(spread >= driver_pp, "driver").when(spread >= borderline_pp, "borderline").otherwise("uniform")
    )


def segment_rows(
    df: DataFrame, segment: str, success: str = "view_item", base: str = "sessions",
    min_share: float = 1.0, exclude: tuple[str, ...] = (NOT_SET,),
) -> DataFrame:
    """Segments worth comparing (share of the base, not excluded), best rate first."""
    total = scalars(df.agg(F.sum(base).alias("n")))["n"]
    kept = df if not exclude else df.where(~F.col(segment).isin(*exclude))
    return (
        kept.select(
            segment, base, success, pct(base, total).alias("share"), pct(success, base).alias("rate")
        )
        .where(F.col("share") >= min_share)
        .orderBy(F.desc("rate"), segment)
    )


def segment_spread(
    df: DataFrame, segment: str, success: str = "view_item", base: str = "sessions",
    min_share: float = 1.0, exclude: tuple[str, ...] = (NOT_SET,),
) -> DataFrame:
    """One row: best and worst segment, spread in points, chi-square, verdict on practical size."""
    rows = segment_rows(df, segment, success, base, min_share, exclude)
    place = F.struct((-F.col("rate")).alias("r"), F.col(segment).alias("s"))
    ends = rows.agg(F.count("*").alias("n_segments"), F.min(place).alias("b"), F.max(place).alias("w"))
    enough = F.col("n_segments") >= 2
    spread = F.col("w.r") - F.col("b.r")
    only = lambda c: F.when(enough, c)
    test = F.col("_t")
    return attach(ends, chi_square(rows, success, base), "_t").select(
        "n_segments",
        only(F.col("b.s")).alias("best"), only(-F.col("b.r")).alias("best_rate"),
        only(F.col("w.s")).alias("worst"), only(-F.col("w.r")).alias("worst_rate"),
        F.when(enough, spread).otherwise(0.0).alias("spread_pp"),
        only(test["chi2"]).alias("chi2"), only(test["dof"]).alias("dof"),
        only(test["p"]).alias("p"), only(test["cramers_v"]).alias("cramers_v"),
        F.when(enough, spread_verdict(spread)).otherwise("too few segments").alias("verdict"),
    )


def compare_periods(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Five funnel rates in two periods (one row of counts each): change, interval, real or not."""
    prev = F.col("_prev")
    rows = []
    for i, (label, num, den) in enumerate(FUNNEL_RATES):
        d, lo, hi = diff_ci(num, den, prev[num], prev[den])
        rows.append(
            F.struct(
                F.lit(i + 1).cast("long").alias("rate_order"), F.lit(label).alias("rate"),
                pct(num, den).alias("current_pct"), pct(prev[num], prev[den]).alias("previous_pct"),
                d.alias("change_pp"), lo.alias("ci_lo"), hi.alias("ci_hi"),
                F.coalesce((lo > 0) | (hi < 0), F.lit(False)).alias("changed"),
            )
        )
    both = attach(current, previous, "_prev")
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*").orderBy("rate_order")


def mix_decomposition(
    a: DataFrame, b: DataFrame, segment: str, n: str = "users", k: str = "successes"
) -> DataFrame:
    """Change of a pooled rate from a to b, split into segment mix and rates within segments (one row)."""
    both = a.select(segment, F.col(n).alias("n_a"), F.col(k).alias("k_a")).join(
        b.select(segment, F.col(n).alias("n_b"), F.col(k).alias("k_b")), segment, "full"
    ).fillna(0, ["n_a", "k_a", "n_b", "k_b"])
    total_a = scalars(a.agg(F.sum(n).cast("double").alias("n")))["n"]
    weighted = (F.col("n_a") / F.nullif(total_a, F.lit(0.0))) * F.coalesce(pct("k_b", "n_b"), F.lit(0.0))
    one = both.agg(
        pct(F.sum("k_a"), F.sum("n_a")).alias("rate_a"), pct(F.sum("k_b"), F.sum("n_b")).alias("rate_b"),
        F.sum(weighted).alias("rate_b_at_a_mix"),
    )
    return one.select(
        "rate_a", "rate_b", "rate_b_at_a_mix", (F.col("rate_b") - F.col("rate_a")).alias("change_pp"),
        (F.col("rate_b_at_a_mix") - F.col("rate_a")).alias("within_pp"),
        (F.col("rate_b") - F.col("rate_b_at_a_mix")).alias("mix_pp"),
        pct(F.col("rate_b") - F.col("rate_b_at_a_mix"), F.col("rate_b") - F.col("rate_a")).alias("mix_share_pct"),
    )


def channel_changes(
    a: DataFrame, b: DataFrame, segment: str = "medium", n: str = "users", k: str = "successes",
    min_share: float = 1.0,
) -> DataFrame:
    """Segments of some size in a, with their rate in both periods and whether it fell."""
    total = scalars(a.agg(F.sum(n).alias("n")))["n"]
    rate_b = b.select(segment, pct(k, n).alias("rate_b"))
    return (
        a.where(F.col(n) * 100 >= F.lit(min_share) * total)
        .select(segment, F.col(n).alias("base_a"), pct(k, n).alias("rate_a"))
        .join(rate_b, segment, "left")
        .withColumn("fell", F.coalesce(F.col("rate_b") < F.col("rate_a"), F.lit(False)))
        .orderBy(F.desc("base_a"), segment)
    )


def channels_fell(a: DataFrame, b: DataFrame, segment: str = "medium", **kw) -> DataFrame:
    """How many of the sizeable segments fell, and the three largest of them (one row; at most 100 / min_share segments)."""
    fallen = F.sort_array(F.collect_list(F.when(F.col("fell"), F.struct(-F.col("base_a"), F.col(segment).alias("name")))))
    return channel_changes(a, b, segment, **kw).agg(
        F.count("*").alias("channels_n"), F.count_if("fell").alias("channels_fell"),
        F.array_join(F.slice(fallen["name"], 1, 3), ", ").alias("examples"),
    )
