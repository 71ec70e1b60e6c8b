"""Session table and user-ordered sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionlens.functions.exprs import country_name, day, null_safe_key, scalars
from sessionlens.model import MICROS_PER_SECOND, STEP_TS, FunnelSpec

SESSION = ("user_pseudo_id", "session_id")
SHOP_DIMS = {
    "device_category": F.col,
    "first_touch_medium": F.col,
    "country": country_name,
}
ATTRIBUTES = (
    "session_medium",
    "n_events",
    "n_medium",
    "n_page_view",
    "engaged_s",
    "session_number",
)


def shop_dims() -> dict[str, Column]:
    """The dimensions every named funnel of the shop uses."""
    return {name: build(name) for name, build in SHOP_DIMS.items()}


def first_value(value: Column, when: Column | None = None) -> Column:
    """Earliest non-null value as (event_timestamp, v), a struct whose minima merge."""
    keep = value.isNotNull() if when is None else value.isNotNull() & when
    return F.min(F.when(keep, F.struct(F.col("event_timestamp"), value.alias("v"))))


def _earliest(value: Column, when: Column | None = None) -> Column:
    """Earliest non-null value by (timestamp, value)."""
    return first_value(value, when)["v"]


def _attribute_aggs() -> list[Column]:
    return [
        _earliest(F.col("medium")).alias("session_medium"),
        F.count("*").alias("n_events"),
        F.count("medium").alias("n_medium"),
        F.count_if(F.col("event_name") == "page_view").alias("n_page_view"),
        (F.sum(F.coalesce("eng_msec", F.lit(0))) / 1000).alias("engaged_s"),
        F.max("session_number").alias("session_number"),
    ]


def _entry_aggs() -> list[Column]:
    """Landing page and first day of the session, over every event."""
    return [
        _earliest(F.col("page_path"), F.col("event_name") == "page_view").alias("landing_page"),
        F.min(day("event_date")).alias("session_date"),
    ]


def _step_aggs(spec: FunnelSpec, dims: dict[str, Column], revenue: bool) -> list[Column]:
    in_funnel = F.col("event_name").isin(*spec.active)
    aggs = [
        F.min(F.when(F.col("event_name") == step, F.col("event_timestamp"))).alias(STEP_TS[step])
        for step in spec.active
    ]
    aggs += [_earliest(value, in_funnel).alias(name) for name, value in dims.items()]
    if revenue:
        paid = F.when(F.col("event_name") == "purchase", F.col("purchase_revenue"))
        aggs.append(F.sum(paid).alias("revenue"))
    return aggs


def with_step_flags(df: DataFrame, spec: FunnelSpec = FunnelSpec()) -> DataFrame:
    """s1…: every step up to this one happened, each first at or after the one before; never null."""
    flags, reached = {}, None
    for i, step in enumerate(spec.active):
        ts = F.col(STEP_TS[step])
        if reached is None:
            reached = ts.isNotNull()
        else:
            reached = F.coalesce(reached & (ts >= F.col(STEP_TS[spec.active[i - 1]])), F.lit(False))
        flags[spec.flags[i]] = reached
    return df.withColumns(flags)


def session_attrs(ev: DataFrame) -> DataFrame:
    """Attributes over every event of a session (rows without a session id are dropped)."""
    return ev.where(F.col("session_id").isNotNull()).groupBy(*SESSION).agg(*_attribute_aggs())


def session_aggs(dims: dict[str, Column] | None = None) -> list[Column]:
    """Steps, dimensions, revenue, attributes and entry of a session, as aggregates over its events."""
    dims = shop_dims() if dims is None else dims
    return [*_step_aggs(FunnelSpec(), dims, True), *_attribute_aggs(), *_entry_aggs()]


def session_base(ev: DataFrame, dims: dict[str, Column] | None = None) -> DataFrame:
    """Everything known per session from ONE aggregation: steps, dimensions, revenue, attributes, entry.

    Conditional minima replace the per-event-name pivot and the joins to attributes and landing
    pages; partial aggregation runs before the shuffle, so one huge session costs one row per task.
    Step flags are stored with it, so filters on them reach the scan of the written table.
    """
    return with_step_flags(ev.where(F.col("session_id").isNotNull()).groupBy(*SESSION).agg(*session_aggs(dims)))


def _any_step(spec: FunnelSpec) -> Column:
    return F.coalesce(*[F.col(STEP_TS[s]) for s in spec.active]).isNotNull()


def _of_known_users(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Attributes belong to a known user: they are null where the user id is."""
    known = F.col("user_pseudo_id").isNotNull()
    return df.withColumns({c: F.when(known, F.col(c)) for c in columns})


def funnel_sessions(base: DataFrame) -> DataFrame:
    """Rows of `session_base` with any funnel event."""
    return _of_known_users(base.where(_any_step(FunnelSpec())), (*ATTRIBUTES, "landing_page", "session_date"))


def sessions(
    ev: DataFrame,
    spec: FunnelSpec = FunnelSpec(),
    event_dims: dict[str, Column] | None = None,
    revenue: bool = False,
    attributes: bool = False,
    extra_keys: tuple[str, ...] = (),
) -> DataFrame:
    """One row per session with any funnel event from the entry on.

    Without attributes only the funnel's events are read (the filter reaches the scan).
    """
    keys = [*SESSION, *extra_keys]
    rows = ev.where(F.col("session_id").isNotNull())
    aggs = _step_aggs(spec, event_dims or {}, revenue)
    if attributes:
        aggs += _attribute_aggs()
    else:
        rows = rows.where(F.col("event_name").isin(*spec.active))
    out = rows.groupBy(*keys).agg(*aggs)
    if attributes:
        out = _of_known_users(out.where(_any_step(spec)), ATTRIBUTES)
    return with_step_flags(out, spec)


def user_sessions(ss: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Sessions in order within each user: rn, t0, earlier cart, next purchase, window end.

    Running values are taken in two levels — inside (user, hour) and over a user's hours — so a user
    holding a large share of all sessions is spread over its hours instead of filling one task.
    """
    width = bucket_seconds * MICROS_PER_SECOND
    t0 = F.coalesce("ts_s", "ts_v", "ts_c", "ts_k", "ts_p")
    rows = (
        ss.withColumn("t0", t0)
        .withColumn("_u", null_safe_key("user_pseudo_id"))
        .withColumn("_b", F.floor(F.col("t0") / width))
    )
    inner = Window.partitionBy("_u", "_b").orderBy("t0", "session_id")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    after = inner.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("_rn", F.row_number().over(inner).cast("long"))
    cart_rn = F.when(F.col("ts_c").isNotNull(), F.col("_rn"))
    detail = rows.withColumns(
        {
            "_cart_ts": F.max("ts_c").over(before),
            "_cart_rn": F.max(cart_rn).over(before),
            "_buy_ts": F.min("ts_p").over(after),
        }
    )
    outer = Window.partitionBy("_u").orderBy("_b")
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    later = outer.rowsBetween(1, Window.unboundedFollowing)
    hours = (
        rows.groupBy("_u", "_b")
        .agg(
            F.count("*").alias("_n"), F.max("ts_c").alias("_c"),
            F.max(cart_rn).alias("_c_rn"), F.min("ts_p").alias("_p"),
        )
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(
            "_u", "_b", "_offset",
            F.max("_c").over(earlier).alias("_hour_cart_ts"),
            F.max(F.col("_offset") + F.col("_c_rn")).over(earlier).alias("_hour_cart_rn"),
            F.min("_p").over(later).alias("_hour_buy_ts"),
        )
    )
    window_end = scalars(ss.agg(F.max(t0).alias("t")))["t"]
    return (
        detail.join(hours, ["_u", "_b"])
        .withColumns(
            {
                "rn": F.col("_offset") + F.col("_rn"),
                "prev_cart_ts": F.greatest("_cart_ts", "_hour_cart_ts"),
                "prev_cart_rn": F.coalesce(F.col("_offset") + F.col("_cart_rn"), F.col("_hour_cart_rn")),
                "next_purchase_ts": F.least("_buy_ts", "_hour_buy_ts"),
                "window_end_ts": window_end,
            }
        )
        .select(
            *ss.columns, "t0", "rn", "prev_cart_ts", "prev_cart_rn", "next_purchase_ts", "window_end_ts"
        )
    )
