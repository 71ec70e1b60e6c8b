"""Sequential funnels and their rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens.functions.exprs import attach, pct, round_half_even, scalars, visitor_type
from sessionlens.model import (
    COUNT_COLUMNS,
    NOT_SET,
    STEP_COUNTS,
    STEP_LABELS,
    STEP_TS,
    STEPS,
    EventWindow,
    FunnelSpec,
)
from sessionlens.operators.sessions import sessions, with_step_flags
from sessionlens.sources.events import PARTITION


# Labels of the funnel segments; device and channel names follow theirs.
SEGMENTS = {
    "all": "All sessions",
    "tagged": "Excluding (not set) · biased up",
    "new": "New sessions",
    "returning": "Returning sessions",
    "device": "Device · ",
    "channel": "Channel · ",
}


def step_counts(spec: FunnelSpec = FunnelSpec()) -> list[Column]:
    """Count columns of a funnel over rows where s1 holds."""
    first, *rest = zip(spec.active, spec.flags)
    return [F.count("*").alias(STEP_COUNTS[first[0]])] + [
        F.count_if(F.col(flag)).alias(STEP_COUNTS[step]) for step, flag in rest
    ]


def funnel_revenue(spec: FunnelSpec = FunnelSpec()) -> Column:
    """Revenue of sessions that completed the sequence."""
    done = F.col(spec.flags[-1])
    return F.round(F.sum(F.when(done, F.coalesce("revenue", F.lit(0.0))).otherwise(0.0)), 2).alias("revenue")


def funnel(
    ss: DataFrame,
    spec: FunnelSpec = FunnelSpec(),
    group_by: dict[str, Column] | None = None,
    revenue: bool = False,
) -> DataFrame:
    """Sessions per step, one row per group (one row without groups)."""
    keys = [value.alias(name) for name, value in (group_by or {}).items()]
    aggs = step_counts(spec) + ([funnel_revenue(spec)] if revenue else [])
    return ss.where("s1").groupBy(*keys).agg(*aggs)


def session_funnel(ss: DataFrame) -> DataFrame:
    return funnel(ss)


def shoppers_funnel(base: DataFrame) -> DataFrame:
    """Funnel of sessions that saw a product; needs no session_start."""
    spec = FunnelSpec(entry="view_item")
    steps = base.select(*[STEP_TS[s] for s in spec.active])
    return funnel(with_step_flags(steps, spec), spec)


def device_funnel(ss: DataFrame) -> DataFrame:
    out = funnel(ss, group_by={"device_category": F.col("device_category")})
    return out.orderBy(F.desc("sessions"), "device_category")


def country_funnel(ss: DataFrame) -> DataFrame:
    out = funnel(ss, group_by={"country": F.coalesce("country", F.lit(NOT_SET))}, revenue=True)
    return out.orderBy(F.desc("sessions"), "country")


def channel_funnel(ss: DataFrame) -> DataFrame:
    """By the session's own medium and by the user's first-touch medium."""
    keys = {c: F.coalesce(c, F.lit(NOT_SET)) for c in ("session_medium", "first_touch_medium")}
    return funnel(ss, group_by=keys, revenue=True).orderBy("session_medium", "first_touch_medium")


def _steps_of(row: list[str]) -> list[dict[str, Column | None]]:
    counts = [F.col(c) for c in row]
    out = []
    for i, n in enumerate(counts):
        before = counts[i - 1] if i else None
        after = counts[i + 1] if i + 1 < len(counts) else None
        out.append({"n": n, "before": before, "after": after, "first": counts[0]})
    return out


def funnel_rates(counts: DataFrame) -> DataFrame:
    """One row per step: share of the step before, share of the first, drop-off, sessions lost next."""
    null = F.lit(None).cast("double")
    rows = []
    for i, (step, s) in enumerate(zip(STEPS, _steps_of(list(COUNT_COLUMNS)))):
        cvr = null if s["before"] is None else round_half_even(pct(s["n"], s["before"]), 1)
        lost = F.lit(0).cast("long") if s["after"] is None else F.greatest(s["n"] - s["after"], F.lit(0))
        rows.append(
            F.struct(
                F.lit(i + 1).cast("long").alias("step_order"),
                F.lit(STEP_LABELS[step]).alias("step"),
                s["n"].alias("sessions"),
                cvr.alias("step_cvr"),
                round_half_even(pct(s["n"], s["first"]), 1).alias("overall_cvr"),
                round_half_even(100 - cvr, 1).alias("drop_off"),
                lost.alias("lost"),
            )
        )
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*").orderBy("step_order")


def step_losses(counts: DataFrame) -> DataFrame:
    """The four losses between steps, largest first."""
    rows = []
    for i, (a, b) in enumerate(zip(STEPS, STEPS[1:])):
        n, m = F.col(STEP_COUNTS[a]), F.col(STEP_COUNTS[b])
        rows.append(
            F.struct(
                F.lit(i + 1).cast("long").alias("step_order"),
                F.lit(STEP_LABELS[a]).alias("from_step"),
                F.lit(STEP_LABELS[b]).alias("to_step"),
                (n - m).alias("lost"),
                round_half_even(100 - round_half_even(pct(m, n), 1), 1).alias("drop_pct"),
            )
        )
    losses = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return losses.orderBy(F.desc("lost"), "step_order")


def channel_basis(ss: DataFrame, min_coverage: float = 0.5) -> Column:
    """'session_medium' when enough funnel sessions carry one, else 'first_touch_medium' (subquery)."""
    tagged = ss.where("s1").agg(
        (F.count_if(F.col("session_medium") != NOT_SET) >= F.lit(min_coverage) * F.count("*")).alias("ok")
    )
    return F.when(scalars(tagged)["ok"], "session_medium").otherwise("first_touch_medium")


def funnel_segments(ss: DataFrame, min_share: float = 1.0) -> DataFrame:
    """One funnel per segment: all, tagged only, new, returning, each device, each channel of some size."""
    cuts = ["attributed", "visitor", "device_category", "channel"]
    rows = ss.where("s1").select(
        "s1", "s2", "s3", "s4", "s5", "device_category",
        (F.col("n_medium") > 0).alias("attributed"),
        visitor_type("session_number").alias("visitor"),
        F.coalesce(
            F.when(channel_basis(ss) == "session_medium", F.col("session_medium")).otherwise(
                F.col("first_touch_medium")
            ),
            F.lit(NOT_SET),
        ).alias("channel"),
    )
    flags = [F.grouping(c).alias(f"_{c}") for c in cuts]
    by_set = rows.groupingSets([[], *[[c] for c in cuts]], *cuts).agg(*step_counts(), *flags)
    of = lambda c: F.col(f"_{c}") == 0
    visitor = visitor_type("session_number")
    total = ss.where("s1").agg(
        F.count("*").alias("n"),
        ((F.count_if(visitor == "new") > 0) & (F.count_if(visitor == "returning") > 0)).alias("both"),
    )
    device = F.concat(F.upper(F.substring("device_category", 1, 1)), F.lower(F.expr("substring(device_category, 2)")))
    kind = (
        F.when(of("attributed"), 2)
        .when(of("visitor") & (F.col("visitor") == "new"), 3)
        .when(of("visitor"), 4)
        .when(of("device_category"), 5)
        .when(of("channel"), 6)
        .otherwise(1)
    )
    label = (
        F.when(of("attributed"), SEGMENTS["tagged"])
        .when(of("visitor"), F.when(F.col("visitor") == "new", SEGMENTS["new"]).otherwise(SEGMENTS["returning"]))
        .when(of("device_category"), F.concat(F.lit(SEGMENTS["device"]), device))
        .when(of("channel"), F.concat(F.lit(SEGMENTS["channel"]), F.col("channel")))
        .otherwise(SEGMENTS["all"])
    )
    kept = (
        F.when(of("attributed"), F.col("attributed"))
        .when(of("visitor"), F.col("visitor").isin("new", "returning") & F.col("_t.both"))
        .when(of("device_category"), F.col("device_category").isNotNull())
        .when(of("channel"), F.col("sessions") * 100 >= F.lit(min_share) * F.col("_t.n"))
        .otherwise(True)
    )
    out = attach(by_set, total, "_t").where(kept).select(kind.cast("long").alias("kind"), label.alias("segment"), *COUNT_COLUMNS)
    return out.orderBy("kind", F.desc("sessions"), "segment")


def period_funnels(ev: DataFrame, current: EventWindow, previous: EventWindow) -> DataFrame:
    """The funnel in two windows that may not overlap, from one scan of their days."""
    if current.shares_days(previous):
        raise ValueError("the two periods overlap")
    day = F.col(PARTITION)
    inside = lambda w: day.between(F.lit(w.first_day), F.lit(w.last_day))
    rows = ev.where(inside(current) | inside(previous)).withColumn(
        "period", F.when(inside(current), "current").otherwise("previous")
    )
    counted = funnel(sessions(rows, extra_keys=("period",)), group_by={"period": F.col("period")})
    return counted.orderBy("period")
