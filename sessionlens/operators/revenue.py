"""Revenue and time-to-convert."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.exprs import attach, ratio, scalars
from sessionlens.functions.ranks import Materialise, exact_quantiles
from sessionlens.model import MICROS_PER_MINUTE, MICROS_PER_SECOND


def revenue_summary(ss: DataFrame, materialise: Materialise = None) -> DataFrame:
    """Revenue of funnel purchases, and of every purchasing session for context (one row)."""
    buyers = ss.where(F.col("ts_p").isNotNull())
    done, paid = F.col("s5"), F.when(F.col("s5") & (F.col("revenue") > 0), F.col("revenue"))
    median = exact_quantiles(buyers.select(paid.alias("v")), [], "v", 0.5, few_groups=True, materialise=materialise)
    med = median.agg(F.round(F.max("q_cont"), 2).alias("m"))
    return buyers.agg(
        F.count_if(done).alias("purchasing_sessions"),
        F.count_if(done & (F.col("revenue") > 0)).alias("orders_with_revenue"),
        F.round(F.sum(F.when(done, F.col("revenue"))), 2).alias("total_revenue"),
        F.round(F.avg(paid), 2).alias("avg_order_value"),
        F.round(F.min(paid), 2).alias("min_order_value"),
        F.round(F.max(paid), 2).alias("max_order_value"),
        F.count("*").alias("all_purchasing_sessions"),
        F.round(F.sum("revenue"), 2).alias("all_revenue"),
        F.count_if(F.col("ts_c").isNull()).alias("purchases_without_cart"),
    ).select(
        "purchasing_sessions", "orders_with_revenue", "total_revenue", "avg_order_value",
        scalars(med)["m"].alias("median_order_value"), "min_order_value", "max_order_value",
        "all_purchasing_sessions", "all_revenue", "purchases_without_cart",
    )


def revenue_reconcile(summary: DataFrame) -> DataFrame:
    """What the headline leaves out: orders without revenue and purchases outside the funnel.

    Revenue per purchase divides by every funnel purchase, so that purchases × rate gives the total.
    """
    return summary.select(
        F.col("purchasing_sessions").alias("funnel_purchases"),
        "orders_with_revenue",
        (F.col("purchasing_sessions") - F.col("orders_with_revenue")).alias("orders_without_revenue"),
        F.coalesce(ratio("total_revenue", "purchasing_sessions"), F.lit(0.0)).alias("revenue_per_purchase"),
        (F.col("all_purchasing_sessions") - F.col("purchasing_sessions")).alias("purchases_outside_funnel"),
        (F.col("all_revenue") - F.col("total_revenue")).alias("revenue_outside_funnel"),
        "purchases_without_cart",
    )


# Step pairs whose gap is timed, and the name of its median.
_GAPS = (
    ("p50_s_to_v", "ts_s", "ts_v"),
    ("p50_v_to_c", "ts_v", "ts_c"),
    ("p50_c_to_k", "ts_c", "ts_k"),
    ("p50_k_to_p", "ts_k", "ts_p"),
    ("p50_total", "ts_s", "ts_p"),
)


def time_to_convert(ss: DataFrame, materialise: Materialise = None) -> DataFrame:
    """Exact median minutes per step of converting sessions, and cart-tracking checks (one row)."""
    gaps = F.array(
        *[
            F.struct(F.lit(name).alias("gap"), ((F.col(b) - F.col(a)) / F.lit(MICROS_PER_MINUTE)).alias("minutes"))
            for name, a, b in _GAPS
        ]
    )
    long = ss.where("s5").select(F.explode(gaps).alias("g")).select("g.*")
    medians = exact_quantiles(long, ["gap"], "minutes", 0.5, few_groups=True, materialise=materialise)
    by_gap = medians.agg(
        *[F.round(F.max(F.when(F.col("gap") == n, F.col("q_cont"))), 1).alias(n) for n, _, _ in _GAPS]
    )
    v, c = F.col("ts_v"), F.col("ts_c")
    counts = (
        ss.where(c.isNotNull())
        .agg(
            F.count_if("s5").alias("converting_sessions"),
            F.count_if(F.col("s5") & (c == v)).alias("converting_same_ts"),
            F.count("*").alias("carting_sessions"),
            F.count_if(c == v).alias("cart_same_ts_as_view"),
            F.count_if(v.isNull() | (c < v)).alias("cart_before_or_without_view"),
            F.count_if((c > v) & (c - v < MICROS_PER_SECOND)).alias("cart_within_1s_after_view"),
        )
    )
    return attach(counts, by_gap, "_m").select(
        "_m.*", "converting_sessions", "converting_same_ts", "carting_sessions", "cart_same_ts_as_view",
        "cart_before_or_without_view", "cart_within_1s_after_view",
    )
