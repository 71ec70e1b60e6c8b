import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionlens.model import EventWindow, FunnelSpec
from sessionlens.operators import funnel, quality, revenue
from sessionlens.operators.sessions import (
    funnel_sessions, session_attrs, session_base, sessions, shop_dims, user_sessions,
)
from tests.shop import event, flat, item

STEPS = ("session_start", "view_item", "add_to_cart", "begin_checkout", "purchase")


def journey(sid, times, user="u1", **kw):
    """Events of one session at the given seconds (None leaves a step out)."""
    return [event(name, user=user, sid=sid, at=t, **kw) for name, t in zip(STEPS, times) if t is not None]


@pytest.fixture(scope="module")
def ev(spark):
    events = (
        journey(1, (0, 0, 0, 0, 0), revenue=None)  # equal timestamps count as in order; purchase without revenue
        + journey(2, (10, 20, 15, None, None)) + [event("add_to_cart", sid=2, at=30)]  # cart before the first view
        + journey(3, (None, 5, 6, 7, 8), revenue=40.0)  # no session_start
        + journey(4, (0, 5, 6, 7, 9), revenue=30.0) + [event("purchase", sid=4, at=12, revenue=5.0)]
        + [event("session_start", sid=None, at=1)]  # no session id
        + journey(5, (0, None, None, None, None), user=None, medium="cpc", number=1)  # no user
        + [event("session_start", sid=6, at=0), event("scroll", sid=6, at=3, medium="email"),
           event("page_view", sid=6, at=2, medium="cpc"), event("page_view", sid=6, at=2, medium="aff")]
        + [event("scroll", sid=7, at=0, medium="cpc")]  # no funnel event at all
    )
    return flat(spark, events)


@pytest.fixture(scope="module")
def ss(ev):
    return funnel_sessions(session_base(ev)).cache()


def by_session(df):
    return {(r["user_pseudo_id"], r["session_id"]): r for r in df.collect()}


def test_flags_follow_first_timestamps(ss):
    rows = by_session(ss)
    flags = lambda sid, user="u1": [rows[user, sid][f] for f in ("s1", "s2", "s3", "s4", "s5")]
    assert flags(1) == [True] * 5
    assert flags(2) == [True, True, False, False, False]
    assert flags(3) == [False] * 5
    assert flags(4) == [True] * 5
    assert flags(5, None) == [True, False, False, False, False]
    assert ("u1", 7) not in rows and len(rows) == 6


def test_attributes(ss):
    rows = by_session(ss)
    assert rows["u1", 6]["session_medium"] == "aff"  # same microsecond: the smaller text
    assert (rows["u1", 6]["n_events"], rows["u1", 6]["n_medium"], rows["u1", 6]["n_page_view"]) == (4, 3, 2)
    assert rows["u1", 2]["session_medium"] is None
    assert rows[None, 5]["session_medium"] is None and rows[None, 5]["n_events"] is None  # unknown user


def test_session_funnel(ss):
    assert funnel.session_funnel(ss).first().asDict() == {
        "sessions": 5, "view_item": 3, "add_to_cart": 2, "begin_checkout": 2, "purchase": 2}


def test_shoppers_funnel_needs_no_session_start(ev):
    row = funnel.shoppers_funnel(session_base(ev)).first().asDict()
    assert row == {"view_item": 4, "add_to_cart": 3, "begin_checkout": 3, "purchase": 3}


def test_sessions_operator_matches_the_shared_table(ev, ss):
    direct = sessions(ev, event_dims=shop_dims(), revenue=True, attributes=True)
    cols = sorted(direct.columns)
    assert sorted(map(str, direct.select(cols).collect())) == sorted(map(str, ss.select(cols).collect()))


def test_entry_view_item_ignores_earlier_steps(ev):
    spec = FunnelSpec(entry="view_item")
    out = sessions(ev, spec)
    assert "ts_s" not in out.columns and out.count() == 4
    assert funnel.funnel(out, spec).first()["view_item"] == 4


def test_revenue_summary(ss):
    r = revenue.revenue_summary(ss).first()
    assert (r["purchasing_sessions"], r["orders_with_revenue"], r["total_revenue"]) == (2, 1, 35.0)
    assert (r["avg_order_value"], r["median_order_value"]) == (35.0, 35.0)
    assert (r["all_purchasing_sessions"], r["all_revenue"], r["purchases_without_cart"]) == (3, 75.0, 0)
    rec = revenue.revenue_reconcile(revenue.revenue_summary(ss)).first()
    assert rec["revenue_per_purchase"] == 17.5 and rec["orders_without_revenue"] == 1


def test_time_to_convert(ss):
    r = revenue.time_to_convert(ss).first()
    assert (r["converting_sessions"], r["carting_sessions"], r["cart_same_ts_as_view"]) == (2, 4, 1)
    assert r["cart_before_or_without_view"] == 1 and r["cart_within_1s_after_view"] == 0
    assert r["p50_total"] == 0.1  # median of 0 and 9 seconds: 0.075 minutes


def test_session_start_check(spark):
    starts = [("u1", 1, 0), ("u1", 1, 0), ("u1", 1, 5), ("u1", 2, 0), ("u2", 1, 7), ("u2", 1, 9)]
    events = [event("session_start", user=u, sid=s, at=t) for u, s, t in starts]
    events += [event("session_start", user=None, sid=3), event("session_start", sid=None), event("scroll")]
    r = quality.session_start_check(flat(spark, events)).first()
    assert r.asDict() == {
        "session_start_events": 8, "events_without_ids": 2, "distinct_sessions": 3, "sessions_with_repeat_start": 2,
        "repeat_start_events": 3, "max_starts_in_one_session": 3, "repeats_with_identical_timestamp": 1,
        "max_seconds_between_repeats": 5.0}


def test_session_quality_cuts_and_medians(spark):
    events = []
    for sid, (n, medium, number, eng) in enumerate([(2, None, 1, 10), (3, "cpc", 1, 20), (4, "cpc", 2, 40), (20, None, None, 0)], 1):
        events += [event("session_start", sid=sid, at=0, number=number, medium=medium, eng=eng * 1000)]
        events += [event("scroll", sid=sid, at=i) for i in range(1, n)]
    q = quality.session_quality(funnel_sessions(session_base(flat(spark, events)))).collect()
    rows = {(r["cut"], r["size_bucket"], r["dev"], r["attributed"], r["visitor"]): r for r in q}
    assert rows["all", None, None, True, None]["median_engaged_s"] == 30.0
    assert rows["all", None, None, True, None]["median_events"] == 3  # first value reaching one half
    assert rows["all", None, None, False, None]["median_events"] == 2
    assert rows["size", "16+", None, False, None]["sessions"] == 1
    assert {k[4] for k in rows if k[0] == "visitor"} == {"new", "returning", "unknown"}
    new = quality.new_vs_returning(spark.createDataFrame(q)).collect()
    assert [r["visitor"] for r in new] == ["new", "returning"]


def test_event_quality(spark):
    listed = [item(), item(), item(quantity=1)]
    events = [event("view_item", items=listed), event("view_item", items=[]), event("view_item"),
              event("add_to_cart", items=listed), event("add_to_cart", items=[item(quantity=1), item(quantity=2)])]
    rows = {r["event_name"]: r for r in quality.event_quality(flat(spark, events)).collect()}
    v, c = rows["view_item"], rows["add_to_cart"]
    assert (v["events"], v["avg_items"], v["multi_item_events"], v["no_item_events"]) == (3, 1.5, 1, 2)
    assert (c["one_carted_item_events"], c["multi_item_events"]) == (1, 2)


def test_period_funnels_cut_sessions_at_the_window(spark):
    events = [event("session_start", sid=1, at=0, day="20201130"), event("view_item", sid=1, at=5, day="20201201"),
              event("session_start", sid=2, at=9, day="20201201"), event("view_item", sid=2, at=9, day="20201201")]
    nov, dec = EventWindow("20201101", "20201130"), EventWindow("20201201", "20201231")
    rows = {r["period"]: r for r in funnel.period_funnels(flat(spark, events), dec, nov).collect()}
    assert (rows["previous"]["sessions"], rows["previous"]["view_item"]) == (1, 0)
    assert (rows["current"]["sessions"], rows["current"]["view_item"]) == (1, 1)
    with pytest.raises(ValueError, match="overlap"):
        funnel.period_funnels(flat(spark, events), dec, EventWindow("20201115", "20201210"))


def test_funnel_rates_and_losses(frame):
    counts = frame("sessions long, view_item long, add_to_cart long, begin_checkout long, purchase long", [(1000, 212, 40, 30, 5)])
    rows = funnel.funnel_rates(counts).collect()
    assert [r["step_cvr"] for r in rows] == [None, 21.2, 18.9, 75.0, 16.7]
    assert [r["overall_cvr"] for r in rows] == [100.0, 21.2, 4.0, 3.0, 0.5]
    assert [r["lost"] for r in rows] == [788, 172, 10, 25, 0]
    assert [r["lost"] for r in funnel.step_losses(counts).collect()] == [788, 172, 25, 10]


def test_funnel_segments_lists_real_segments(spark):
    events = []
    for sid in range(1, 201):
        dev = "mobile" if sid % 4 == 0 else "desktop"
        events.append(event("session_start", sid=sid, at=sid, number=1 + sid % 2, device=dev, medium="cpc" if sid > 1 else "rare"))
    out = funnel.funnel_segments(funnel_sessions(session_base(flat(spark, events)))).collect()
    assert [r["segment"] for r in out] == [
        "All sessions", "Excluding (not set) · biased up", "New sessions", "Returning sessions", "Device · Desktop",
        "Device · Mobile", "Channel · cpc"]


def _brute(rows):
    """rn, earlier cart, its rn and next purchase per user, one row at a time."""
    out = {}
    end = max(min(t for t in r[2:] if t is not None) if r[2] is None else r[2] for r in rows)
    users = {r[0] for r in rows}
    for u in users:
        mine = sorted(
            (r for r in rows if r[0] == u), key=lambda r: (next(t for t in r[2:] if t is not None), r[1])
        )
        for i, r in enumerate(mine):
            carts = [(x[4], j + 1) for j, x in enumerate(mine[:i]) if x[4] is not None]
            buys = [x[6] for x in mine[i + 1:] if x[6] is not None]
            out[u, r[1]] = (
                i + 1, max((c for c, _ in carts), default=None), max((j for _, j in carts), default=None),
                min(buys, default=None),
            )
    return out, end


def test_user_sessions_match_brute_force_with_a_hot_user(frame):
    rng = random.Random(3)
    rows, sid = [], 0
    for user, n in (("hot", 400), (None, 120), ("a", 5), ("b", 1), ("c", 30)):
        for _ in range(n):
            sid += 1
            start = rng.randrange(0, 40 * 3600) * 1_000_000 if rng.random() < 0.8 else 3_600_000_000
            later = lambda p: start + rng.randrange(0, 7200) * 1_000_000 if rng.random() < p else None
            ts_s = start if rng.random() < 0.9 else None
            rows.append((user, sid, ts_s, start if ts_s is None else later(0.5), later(0.3), later(0.1), later(0.2)))
    df = frame("user_pseudo_id string, session_id long, ts_s long, ts_v long, ts_c long, ts_k long, ts_p long", rows)
    expected, end = _brute(rows)
    got = user_sessions(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = expected[r["user_pseudo_id"], r["session_id"]]
        assert (r["rn"], r["prev_cart_ts"], r["prev_cart_rn"], r["next_purchase_ts"]) == want
    starts = [next(t for t in r[2:] if t is not None) for r in rows]
    assert {r["window_end_ts"] for r in got} == {max(starts)}


def test_adapter_sessions_match_event_by_event_gaps(spark):
    """The hour-bucket rule finds the same sessions as looking at every event."""
    from sessionlens.sources.driver_tables import shop_events, table

    sf = "/root/testdata/sf0.001"
    own = table(spark, sf, "events").select("user_id", "ts").toPandas().sort_values(["user_id", "ts"])
    own["us"] = own["ts"].astype("datetime64[us]").astype("int64")
    gap = own.groupby("user_id")["us"].diff()
    own["opens"] = gap.isna() | (gap > 12 * 3600 * 1_000_000)
    expected = own[own["opens"]].groupby("user_id")["us"].apply(lambda s: sorted(s // 1_000_000)).to_dict()
    ev = shop_events(spark, sf)
    from sessionlens.functions.exprs import param

    got = ev.select(F.col("user_pseudo_id").cast("long").alias("u"), param("ga_session_id").alias("s")).distinct().toPandas()
    assert {u: sorted(g["s"]) for u, g in got.groupby("u")} == expected


def test_attrs_cover_every_session(ev):
    assert session_attrs(ev).count() == 7
