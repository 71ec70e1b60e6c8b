"""One SQL statement per registered query."""

from __future__ import annotations

from checks.oracles import (
    CTE, COUNTS, PATHS, RATE_COLUMNS, RATES, REVENUE, VISITOR, chi2_cte, count_if, newcombe, pct, ratio, statement, total,
    wilson,
)

_EVENT_COLUMNS = "name AS event_name, uid AS user_pseudo_id, sid AS session_id, ts AS event_timestamp"
_STAGES = (
    ("Session Start", "sessions"), ("View Products", "view_item"), ("Add to Cart", "add_to_cart"),
    ("Begin Checkout", "begin_checkout"), ("Purchase", "purchase"),
)
_FUNNEL_RATES = (
    ("Saw a product", "view_item", "sessions"), ("Saw → carted", "add_to_cart", "view_item"),
    ("Cart → checkout", "begin_checkout", "add_to_cart"), ("Checkout → purchase", "purchase", "begin_checkout"),
    ("Session → purchase", "purchase", "sessions"),
)
_BANDS = ("under $10", "$10–20", "$20–30", "$30–50", "$50+")
_BUCKETS = ("1–3", "4–5", "6–8", "9–15", "16+")


def _values(labels) -> str:
    return "(VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{x}')" for i, x in enumerate(labels, 1)) + ")"


def _period(first: str, last: str) -> str:
    """Funnel over sessions seen through the events of some days only."""
    return f"""SELECT {COUNTS} FROM (SELECT *, ts_s IS NOT NULL AS s1, coalesce(ts_v>=ts_s,false) AS s2,
        coalesce(ts_v>=ts_s AND ts_c>=ts_v,false) AS s3, coalesce(ts_v>=ts_s AND ts_c>=ts_v AND ts_k>=ts_c,false) AS s4,
        coalesce(ts_v>=ts_s AND ts_c>=ts_v AND ts_k>=ts_c AND ts_p>=ts_k,false) AS s5 FROM (SELECT uid, sid,
        min(ts) FILTER (WHERE name='session_start') AS ts_s, min(ts) FILTER (WHERE name='view_item') AS ts_v,
        min(ts) FILTER (WHERE name='add_to_cart') AS ts_c, min(ts) FILTER (WHERE name='begin_checkout') AS ts_k,
        min(ts) FILTER (WHERE name='purchase') AS ts_p FROM @ev WHERE d BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY 1,2)) WHERE s1"""


_CUR, _PREV = _period("2024-01-16", "2024-01-30"), _period("2024-01-01", "2024-01-15")


def _funnel_rates() -> str:
    parts = []
    for i, (label, col) in enumerate(_STAGES):
        prev = _STAGES[i - 1][1] if i else None
        nxt = _STAGES[i + 1][1] if i < 4 else None
        cvr = f"round_even({pct(col, prev)},1)" if prev else "CAST(NULL AS DOUBLE)"
        lost = f"greatest({col}-{nxt},0)" if nxt else "CAST(0 AS BIGINT)"
        parts.append(
            f"SELECT CAST({i + 1} AS BIGINT) AS step_order, '{label}' AS step, {col} AS sessions, {cvr} AS step_cvr, "
            f"round_even({pct(col, 'sessions')},1) AS overall_cvr, round_even(100-{cvr},1) AS drop_off, {lost} AS lost FROM @fun"
        )
    # `sessions` is both a count column and the output name, so the base goes through an alias
    return " UNION ALL ".join(parts)


def _step_losses() -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS BIGINT) AS step_order, '{a[0]}' AS from_step, '{b[0]}' AS to_step, {a[1]}-{b[1]} AS lost, "
        f"round_even(100-round_even({pct(b[1], a[1])},1),1) AS drop_pct FROM @fun"
        for i, (a, b) in enumerate(zip(_STAGES, _STAGES[1:]))
    )


def _compare() -> str:
    rows = []
    for i, (label, num, den) in enumerate(_FUNNEL_RATES):
        d, lo, hi = newcombe(f"c.{num}", f"c.{den}", f"p.{num}", f"p.{den}")
        rows.append(
            f"SELECT CAST({i + 1} AS BIGINT) AS rate_order, '{label}' AS rate, {pct(f'c.{num}', f'c.{den}')} AS current_pct, "
            f"{pct(f'p.{num}', f'p.{den}')} AS previous_pct, {d} AS change_pp, {lo} AS ci_lo, {hi} AS ci_hi, "
            f"coalesce({lo}>0 OR {hi}<0,false) AS changed FROM ({_CUR}) c, ({_PREV}) p"
        )
    return " UNION ALL ".join(rows)


def _segments() -> str:
    by = "coalesce((SELECT CASE WHEN basis='session_medium' THEN session_medium ELSE first_touch_medium END FROM @chb),'(not set)')"
    f = f"(SELECT *, {VISITOR} AS visitor, {by} AS channel FROM @ss WHERE s1)"
    cols = COUNTS
    return f"""SELECT CAST(1 AS BIGINT) AS kind, 'All sessions' AS segment, {cols} FROM {f}
        UNION ALL SELECT 2, 'Excluding (not set) · biased up', {cols} FROM {f} WHERE n_medium>0
        UNION ALL SELECT CASE visitor WHEN 'new' THEN 3 ELSE 4 END, CASE visitor WHEN 'new' THEN 'New sessions' ELSE 'Returning sessions' END, {cols}
          FROM {f} WHERE visitor IN ('new','returning') GROUP BY visitor
        UNION ALL SELECT 5, 'Device · '||upper(device_category[1])||lower(device_category[2:]), {cols} FROM {f} GROUP BY device_category
        UNION ALL SELECT 6, 'Channel · '||channel, {cols} FROM {f} GROUP BY channel HAVING count(*)*100>=(SELECT sessions FROM @fun)"""


def _mix(a: str, b: str) -> str:
    inner = f"""SELECT coalesce(a.medium,b.medium) AS medium, coalesce(a.users,0) AS na, coalesce(a.successes,0) AS ka,
        coalesce(b.users,0) AS nb, coalesce(b.successes,0) AS kb FROM {a} a FULL JOIN {b} b ON a.medium=b.medium"""
    return f"""SELECT rate_a, rate_b, rate_b_at_a_mix, rate_b-rate_a AS change_pp, rate_b_at_a_mix-rate_a AS within_pp, rate_b-rate_b_at_a_mix AS mix_pp,
        {pct('(rate_b-rate_b_at_a_mix)', '(rate_b-rate_a)')} AS mix_share_pct
        FROM (SELECT {pct('sum(ka)', 'sum(na)')} AS rate_a, {pct('sum(kb)', 'sum(nb)')} AS rate_b,
        sum(CAST(na AS DOUBLE)/nullif((SELECT CAST(sum(users) AS DOUBLE) FROM {a}),0)*coalesce({pct('kb', 'nb')},0)) AS rate_b_at_a_mix FROM ({inner}))"""


def _changes(a: str, b: str) -> str:
    return f"""SELECT a.medium, CAST(a.users AS BIGINT) AS base_a, {pct('a.successes', 'a.users')} AS rate_a, {pct('b.successes', 'b.users')} AS rate_b,
        coalesce({pct('b.successes', 'b.users')}<{pct('a.successes', 'a.users')},false) AS fell FROM {a} a LEFT JOIN {b} b ON a.medium=b.medium
        WHERE a.users*100>=1.0*(SELECT sum(users) FROM {a})"""


def _spread(rows: str, seg: str) -> str:
    kept = f"""SELECT {seg}, sessions, view_item, {pct('sessions', f'(SELECT sum(sessions) FROM {rows})')} AS share, {pct('view_item', 'sessions')} AS rate
        FROM {rows} WHERE {seg}<>'(not set)'"""
    return f"SELECT * FROM ({kept}) WHERE share>=1.0"


def _device_steps() -> str:
    return " UNION ALL ".join(
        f"SELECT device_category, CAST({i} AS BIGINT) AS step_order, '{label}' AS step, {col} AS sessions, "
        f"round_even({pct(col, 'd.sessions')},2) AS pct FROM @dev d"
        for i, (label, col) in enumerate(_STAGES, 1)
    )


def _lift() -> str:
    orders = f"round_even((sessions*lift//100)*{ratio('purchase', 'view_item')},0)"
    revenue = f"round_even({orders}*coalesce({ratio('total_revenue', 'purchase')},0),0)"
    return f"""SELECT lift AS lift_pp, keep AS keep_pct, sessions*lift//100 AS extra_views, CAST(round_even({orders}*keep/100,0) AS BIGINT) AS extra_orders,
        round_even({revenue}*keep/100,0) AS extra_revenue FROM @tot, (VALUES (CAST(5 AS BIGINT)),(10)) a(lift), (VALUES (CAST(50 AS BIGINT)),(75),(100)) b(keep)"""


_PER = f"coalesce({ratio('t.total_revenue', 't.purchase')},0)"
_LANDING_SIZING = f"""SELECT weak_pages, weak_landings, {pct('weak_landings', 't.sessions')} AS weak_share, real_pages, real_landings, extra_views,
    coalesce({pct('lost', '(t.sessions-t.view_item)')},0) AS lost_share, coalesce({pct('ua', 'weak_landings')},0) AS untagged_pct,
    coalesce({pct('nw', 'weak_landings')},0) AS new_pct, tracking_pages, page_fail_pages, entry_pages, entry_inside_lo, entry_inside_hi,
    coalesce(entry_untagged_pct,0) AS entry_untagged_pct, entry_landed_eng_s, entry_inside_eng_s,
    CAST(round_even(extra_views*{ratio('t.purchase', 't.view_item')},0) AS BIGINT) AS orders,
    round_even(round_even(round_even(extra_views*{ratio('t.purchase', 't.view_item')},0)*{_PER},0)*0.5,0) AS revenue_low,
    round_even(round_even(extra_views*{ratio('t.purchase', 't.view_item')},0)*{_PER},0) AS revenue_high FROM @tot t, (SELECT
    CAST(count(*) AS BIGINT) AS weak_pages, {total('coalesce(w.sessions,0)')} AS weak_landings, {count_if("verdict<>'tracking'")} AS real_pages,
    CAST(coalesce(sum(w.sessions) FILTER (WHERE verdict<>'tracking'),0) AS BIGINT) AS real_landings,
    CAST(coalesce(sum(extra_views) FILTER (WHERE verdict<>'tracking'),0) AS BIGINT) AS extra_views, sum(w.sessions-w.view_item) AS lost,
    sum(unattributed_sessions) AS ua, sum(new_sessions) AS nw, {count_if("verdict='tracking'")} AS tracking_pages, {count_if("verdict='page'")} AS page_fail_pages,
    {count_if("verdict='entry traffic'")} AS entry_pages, min(inside_rate) FILTER (WHERE verdict='entry traffic') AS entry_inside_lo,
    max(inside_rate) FILTER (WHERE verdict='entry traffic') AS entry_inside_hi,
    sum(unattributed_sessions) FILTER (WHERE verdict='entry traffic')/sum(w.sessions) FILTER (WHERE verdict='entry traffic')*100 AS entry_untagged_pct,
    sum(landed_eng_s*w.sessions) FILTER (WHERE verdict='entry traffic')/sum(w.sessions) FILTER (WHERE verdict='entry traffic') AS entry_landed_eng_s,
    sum(inside_eng_s*inside_sessions) FILTER (WHERE verdict='entry traffic')/sum(inside_sessions) FILTER (WHERE verdict='entry traffic') AS entry_inside_eng_s
    FROM @weak w LEFT JOIN @ver v ON v.page_path=w.landing_page)"""
_CART_ORDERS = f"round_even((t.add_to_cart-t.begin_checkout)*CAST(0.1 AS DOUBLE)*{ratio('t.purchase', 't.begin_checkout')},0)"
_CART_SIZING = f"""SELECT add_to_cart-begin_checkout AS abandoned, CAST({_CART_ORDERS} AS BIGINT) AS orders, round_even({_CART_ORDERS}*{_PER},0) AS revenue,
    coalesce({pct('(begin_checkout+(add_to_cart-begin_checkout)*CAST(0.1 AS DOUBLE))', 'add_to_cart')},0) AS checkout_target_pct FROM @tot t"""
_REENGAGE = f"""SELECT cohorts, base_users, returned_users, extra_users,
    round_even(extra_users*(SELECT max(rev_per_session) FROM @nvr WHERE visitor='new'),0) AS revenue_low,
    round_even(extra_users*(SELECT max(rev_per_session) FROM @nvr WHERE visitor='returning'),0) AS revenue_high FROM (
    SELECT CAST(count(*) AS BIGINT) AS cohorts, CAST(coalesce(sum(b),0) AS BIGINT) AS base_users, CAST(coalesce(sum(r),0) AS BIGINT) AS returned_users,
    greatest(0,CAST(round_even(coalesce(sum(b),0)*CAST(8 AS DOUBLE)/100-coalesce(sum(r),0),0) AS BIGINT)) AS extra_users FROM (
    SELECT z.active_users AS b, o.active_users AS r FROM @mx z JOIN @mx o ON o.cohort_week=z.cohort_week AND o.weeks_since_cohort=1
    WHERE z.weeks_since_cohort=0 AND z.cohort_week>=DATE '1995-01-01' AND o.active_users IS NOT NULL))"""
_CATALOGUE = f"""SELECT pages, coalesce(targets,'') AS targets, carts_at_stake, CAST(round_even(carts_at_stake*{ratio('t.purchase', 't.add_to_cart')},0) AS BIGINT) AS orders,
    round_even(round_even(round_even(carts_at_stake*{ratio('t.purchase', 't.add_to_cart')},0)*{_PER},0)*0.5,0) AS revenue_low,
    round_even(round_even(carts_at_stake*{ratio('t.purchase', 't.add_to_cart')},0)*{_PER},0) AS revenue_high FROM @tot t, (SELECT CAST(count(*) AS BIGINT) AS pages,
    string_agg(item_category, ', ' ORDER BY carts_at_stake DESC, item_category) AS targets, CAST(coalesce(sum(carts_at_stake),0) AS BIGINT) AS carts_at_stake FROM @top)"""

_w = {name: wilson(k, n) for name, k, n in (
    ("purchase", "purchase", "sessions"), ("cart", "carting_sessions", "viewing_sessions"), ("rec", "recovered", "eligible_carts"),
)}
_d = newcombe("c.view_item", "c.sessions", "f.view_item", "f.sessions")
_TEST = "chi2 p cramers_v"

# Spearman: average ranks by counting, p by Simpson integration of cos^(n−3) over the angle of t.
_RANKS = """SELECT a.median_price, a.atc_pct,
    (SELECT count(*) FILTER (WHERE b.median_price<a.median_price)+(count(*) FILTER (WHERE b.median_price=a.median_price)+1)/2.0 FROM @rk b WHERE b.median_price IS NOT NULL) AS rx,
    (SELECT count(*) FILTER (WHERE b.atc_pct<a.atc_pct)+(count(*) FILTER (WHERE b.atc_pct=a.atc_pct)+1)/2.0 FROM @rk b WHERE b.median_price IS NOT NULL) AS ry
    FROM @rk a WHERE median_price IS NOT NULL"""
_SIMPSON = (
    "list_sum(list_transform(range(0,2001), lambda i: (CASE WHEN i=0 OR i=2000 THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)"
    "*pow(cos({top}*i/2000.0),n-3)))*{top}/6000.0"
)
_SPEARMAN = f"""SELECT n, CASE WHEN n>=5 THEN rho END AS rho, CASE WHEN n>=5 THEN CASE WHEN abs(rho)>=1 THEN 0.0 ELSE
    1-({_SIMPSON.format(top='atan(abs(rho)/sqrt(1-rho*rho))')})/({_SIMPSON.format(top='(pi()/2)')}) END END AS p
    FROM (SELECT CAST(count(*) AS BIGINT) AS n, corr(rx,ry) AS rho FROM ({_RANKS}))"""

_FLAT = """d AS event_date_part, event_date, ts AS event_timestamp, name AS event_name, uid AS user_pseudo_id, sid AS session_id,
    session_number, medium, eng AS eng_msec, path AS page_path, device AS device_category, country, first_touch AS first_touch_medium,
    rev AS purchase_revenue, CAST(n_items AS BIGINT) AS n_items"""

# name → (SELECT, double columns)
STATEMENTS: dict[str, tuple[str, str]] = {
    # scans and sinks
    "scan_events": (f"SELECT event_name, CAST(count(*) AS BIGINT) AS events, min(event_timestamp) AS first_ts, max(event_timestamp) AS last_ts FROM (SELECT {_EVENT_COLUMNS}, d FROM @ev) WHERE d BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1", ""),
    "date_range": ("SELECT min(event_date) AS earliest_date, max(event_date) AS latest_date, CAST(count(DISTINCT event_date) AS BIGINT) AS num_daily_tables FROM @ev", ""),
    "flatten_events": (f"SELECT {_FLAT} FROM @ev", "purchase_revenue"),
    "write_star_schema": ("""SELECT 'fct_sessions' AS table_name, CAST(count(*) AS BIGINT) AS rows FROM @fct
        UNION ALL SELECT 'fct_session_listing', count(*) FROM @sc WHERE fv IS NOT NULL UNION ALL SELECT 'fct_session_price_band', count(*) FROM @sb WHERE fv IS NOT NULL
        UNION ALL SELECT 'dim_users', count(DISTINCT uid) FROM @ev UNION ALL SELECT 'fct_user_activity', count(*) FROM (SELECT DISTINCT uid, date_trunc('week',d) FROM @ev WHERE name='session_start')
        UNION ALL SELECT 'agg_cohort_channel', count(*) FROM (SELECT DISTINCT wk, coalesce(session_medium,'(not set)') FROM (SELECT date_trunc('week',session_date) AS wk, session_medium FROM @ss
          QUALIFY row_number() OVER (PARTITION BY user_pseudo_id ORDER BY ts_s, session_id)=1))
        UNION ALL SELECT 'dim_price_band', 5 UNION ALL SELECT 'dim_listing', count(*) FROM @lp UNION ALL SELECT 'landing_diagnosis', count(*) FROM @ver
        UNION ALL SELECT 'stats_tests', count(DISTINCT test) FROM @tst0""", ""),
    "publish_if_changed": ("""SELECT d.*, CAST(n AS BIGINT) AS copies, true AS published FROM (SELECT *, 1 AS n FROM @dev UNION ALL
        SELECT * REPLACE (purchase+1 AS purchase), -1 FROM @dev) t, LATERAL (SELECT t.* EXCLUDE (n)) d""", ""),
    # column builders
    "param": ("SELECT event_id_free.* FROM (SELECT ts AS event_timestamp, uid AS user_pseudo_id, name AS event_name, sid AS ga_session_id, medium, eng AS engagement_time_msec, session_number AS ga_session_number, url AS page_location FROM @ev) event_id_free", ""),
    "page_path": ("SELECT url, path AS page_path, CAST(count(*) AS BIGINT) AS events FROM @ev GROUP BY 1,2", ""),
    "category_label": ("SELECT raw AS raw_category, item_category, CAST(count(*) AS BIGINT) AS items FROM @itl GROUP BY 1,2", ""),
    "parent_node": ("SELECT raw AS raw_category, parent AS parent_node, CAST(count(*) AS BIGINT) AS items FROM @itl GROUP BY 1,2", ""),
    "price_band": ("SELECT price, price_band, CAST(count(*) AS BIGINT) AS items FROM @itl GROUP BY 1,2", "price"),
    "size_bucket": ("SELECT n_events, size_bucket, CAST(count(*) AS BIGINT) AS sessions FROM @qf GROUP BY 1,2", ""),
    "visitor_type": (f"SELECT session_number, {VISITOR} AS visitor_type, CAST(count(*) AS BIGINT) AS sessions FROM @ss GROUP BY 1,2", ""),
    "week_start": ("SELECT event_date, CAST(date_trunc('week',d) AS DATE) AS week, CAST(count(*) AS BIGINT) AS events FROM @ev GROUP BY 1,2", ""),
    "session_key": ("SELECT user_pseudo_id, session_id, user_pseudo_id||'-'||CAST(session_id AS VARCHAR) AS session_key FROM @ss", ""),
    "items_quality": (f"SELECT name AS event_name, n_items AS items, CAST(CASE WHEN n_items IS NOT NULL THEN n_carted END AS BIGINT) AS carted, CAST(count(*) AS BIGINT) AS events FROM @ev GROUP BY 1,2,3", ""),
    "is_shopping_page": ("SELECT path AS page_path, NOT regexp_matches(path,'(?i)sign-?in|log-?in|register|my-?account|basket|cart|checkout|store-policies|faq') AS is_shopping_page, CAST(count(*) AS BIGINT) AS events FROM @ev GROUP BY 1,2", ""),
    "p_label": (f"SELECT test, CASE WHEN p>=0.001 THEN printf('p = %.3f',p) ELSE 'p < 0.001' END AS p_label FROM ({chi2_cte('SELECT * FROM @tst0','k','n','test')})", ""),
    # sessions and funnels
    "session_attrs": ("SELECT user_pseudo_id, session_id, session_medium, n_events, n_medium, n_page_view, engaged_s, session_number FROM @base", "engaged_s"),
    "sessions": ("SELECT user_pseudo_id, session_id, ts_s, ts_v, ts_c, ts_k, ts_p, device_category, revenue, session_medium, n_events, n_medium, n_page_view, engaged_s, session_number, s1, s2, s3, s4, s5 FROM @ss", "revenue engaged_s"),
    "session_days": ("SELECT user_pseudo_id, session_id, ts_s, ts_v, ts_c, ts_k, ts_p, device_category, revenue, session_medium, n_events, n_medium, n_page_view, engaged_s, session_number, s1, s2, s3, s4, s5 FROM @ss", "revenue engaged_s"),
    "stream_sessions": ("SELECT user_pseudo_id, session_id, ts_s, ts_v, ts_c, ts_k, ts_p, device_category, first_touch_medium, country, revenue, session_medium, n_events, n_medium, n_page_view, engaged_s, session_number, s1, s2, s3, s4, s5 FROM @ss", "revenue engaged_s"),
    "stream_funnel": ("SELECT * FROM @fun", ""),
    "scan_estimate": ("SELECT c AS \"column\", (SELECT count(*) FROM @ev WHERE d BETWEEN DATE '2024-01-08' AND DATE '2024-01-14') AS rows, true AS cheaper, true AS within_budget FROM (VALUES ('event_name'), ('event_timestamp'), ('user_pseudo_id')) v(c)", ""),
    "funnel": (f"SELECT {VISITOR} AS visitor, {COUNTS}, {REVENUE} FROM @ss WHERE s1 GROUP BY 1", "revenue"),
    "session_funnel": ("SELECT * FROM @fun", ""),
    "shoppers_funnel": (f"SELECT CAST(count(*) AS BIGINT) AS view_item, {count_if('ts_c>=ts_v')} AS add_to_cart, {count_if('ts_c>=ts_v AND ts_k>=ts_c')} AS begin_checkout, {count_if('ts_c>=ts_v AND ts_k>=ts_c AND ts_p>=ts_k')} AS purchase FROM @base WHERE ts_v IS NOT NULL", ""),
    "device_funnel": ("SELECT * FROM @dev", ""),
    "country_funnel": ("SELECT * FROM @cty", "revenue"),
    "channel_funnel": ("SELECT * FROM @cnt", "revenue"),
    "funnel_rates": (_funnel_rates(), "step_cvr overall_cvr drop_off"),
    "step_losses": (_step_losses(), "drop_pct"),
    "funnel_segments": (_segments(), ""),
    "period_funnels": (f"SELECT 'current' AS period, * FROM ({_CUR}) UNION ALL SELECT 'previous', * FROM ({_PREV})", ""),
    # revenue and quality
    "revenue_summary": ("SELECT * FROM @rv", "total_revenue avg_order_value median_order_value min_order_value max_order_value all_revenue"),
    "revenue_reconcile": (f"SELECT purchasing_sessions AS funnel_purchases, orders_with_revenue, purchasing_sessions-orders_with_revenue AS orders_without_revenue, coalesce({ratio('total_revenue','purchasing_sessions')},0) AS revenue_per_purchase, all_purchasing_sessions-purchasing_sessions AS purchases_outside_funnel, all_revenue-total_revenue AS revenue_outside_funnel, purchases_without_cart FROM @rv", "revenue_per_purchase revenue_outside_funnel"),
    "session_quality": ("SELECT * FROM @sq", "revenue median_engaged_s"),
    "untagged_profile": (f"SELECT o.i AS bucket_order, o.b AS bucket, CAST(coalesce(tg,0)+coalesce(ua,0) AS BIGINT) AS sessions, {pct('coalesce(ua,0)','(coalesce(tg,0)+coalesce(ua,0))')} AS ua_pct, {pct('uv','ua')} AS view_ua, {pct('av','tg')} AS view_at FROM {_values(_BUCKETS)} o(i,b) LEFT JOIN (SELECT size_bucket, sum(sessions) FILTER (WHERE attributed) AS tg, sum(sessions) FILTER (WHERE NOT attributed) AS ua, sum(view_item) FILTER (WHERE attributed) AS av, sum(view_item) FILTER (WHERE NOT attributed) AS uv FROM @sq WHERE cut='size' GROUP BY 1) z ON z.size_bucket=o.b", "ua_pct view_ua view_at"),
    "untagged_overall": (f"""SELECT u.sessions AS ua_sessions, {pct('u.sessions','(u.sessions+a.sessions)')} AS ua_share, {pct('u.view_item','u.sessions')} AS ua_view_pct, {pct('a.view_item','a.sessions')} AS at_view_pct,
        {pct('u.with_page_view','u.sessions')} AS ua_pv_pct, {pct('a.with_page_view','a.sessions')} AS at_pv_pct, u.median_engaged_s AS ua_median_engaged_s, a.median_engaged_s AS at_median_engaged_s,
        u.median_events AS ua_median_events, a.median_events AS at_median_events, {pct('(u.sessions-u.view_item)','(u.sessions+a.sessions-u.view_item-a.view_item)')} AS ua_lost_share,
        (SELECT min(x) FROM @dsh) AS ua_device_min_pct, (SELECT max(x) FROM @dsh) AS ua_device_max_pct
        FROM (SELECT * FROM @sq WHERE cut='all' AND NOT attributed) u, (SELECT * FROM @sq WHERE cut='all' AND attributed) a""",
        "ua_share ua_view_pct at_view_pct ua_pv_pct at_pv_pct ua_median_engaged_s at_median_engaged_s ua_lost_share ua_device_min_pct ua_device_max_pct"),
    "sensitivity_funnel": (f"SELECT 'all sessions' AS basis, sessions, {RATES} FROM (SELECT {COUNTS}, sum(CASE WHEN s5 THEN coalesce(revenue,0) ELSE 0 END) AS revenue FROM @ss WHERE s1) UNION ALL SELECT 'excluding untagged', sessions, {RATES} FROM (SELECT {COUNTS}, sum(CASE WHEN s5 THEN coalesce(revenue,0) ELSE 0 END) AS revenue FROM @ss WHERE s1 AND n_medium>0)", RATE_COLUMNS),
    "new_vs_returning": ("SELECT * FROM @nvr", f"{RATE_COLUMNS} ci_lo ci_hi cvr_ratio chi2 p cramers_v"),
    "event_inventory": ("SELECT name AS event_name, CAST(count(*) AS BIGINT) AS event_count, CAST(count(DISTINCT uid) AS BIGINT) AS unique_users FROM @ev GROUP BY 1", ""),
    "cart_views": ("""SELECT user_pseudo_id, session_id, CAST(count(*) AS BIGINT) AS views, min(ts) AS first_view_ts, max(ts) AS last_view_ts FROM @base
        JOIN @ev ON uid = user_pseudo_id AND name='view_item' AND ts BETWEEN ts_c AND coalesce(ts_p, ts_c+604800000000) GROUP BY 1,2""", ""),
    "sketch_weeks": ("""SELECT coalesce(u.week, c.week) AS week, coalesce(unique_users, 0) AS unique_users, coalesce(conversions, 0) AS conversions, true AS users_within, true AS median_within FROM
        (SELECT CAST(date_trunc('week',d) AS DATE) AS week, CAST(count(DISTINCT uid) AS BIGINT) AS unique_users FROM @ev WHERE name='session_start' GROUP BY 1) u FULL JOIN
        (SELECT CAST(date_trunc('week',session_date) AS DATE) AS week, CAST(count(*) AS BIGINT) AS conversions FROM @ss WHERE s5 GROUP BY 1) c ON u.week = c.week""", ""),
    "unique_users": ("SELECT CAST(count(DISTINCT uid) AS BIGINT) AS unique_users FROM @ev WHERE name='session_start'", ""),
    "session_start_check": (f"""SELECT (SELECT CAST(count(*) AS BIGINT) FROM @ev WHERE name='session_start') AS session_start_events, {total('CASE WHEN sid IS NULL THEN 1 ELSE 0 END')} AS events_without_ids,
        CAST(count(*) AS BIGINT) AS distinct_sessions, {count_if('n>1')} AS sessions_with_repeat_start, CAST(coalesce(sum(n-1),0) AS BIGINT) AS repeat_start_events,
        CAST(coalesce(max(n),0) AS BIGINT) AS max_starts_in_one_session, {count_if('n>1 AND nt<n')} AS repeats_with_identical_timestamp, max(CASE WHEN n>1 THEN span END) AS max_seconds_between_repeats
        FROM (SELECT uid, sid, count(*) AS n, count(DISTINCT ts) AS nt, (max(ts)-min(ts))/CAST(1e6 AS DOUBLE) AS span FROM @ev WHERE name='session_start' GROUP BY 1,2)""", "max_seconds_between_repeats"),
    "event_quality": ("SELECT * FROM @eq", "avg_items"),
    "event_quality_rates": (f"""SELECT v.avg_items AS vi_avg_items, {pct('v.multi_item_events','v.events')} AS vi_multi_pct, {pct('v.no_item_events','v.events')} AS vi_no_item_pct, a.avg_items AS atc_avg_items,
        {pct('a.one_carted_item_events','a.events')} AS atc_one_pct, coalesce({pct('t.cart_same_ts_as_view','t.carting_sessions')},0) AS cart_same_ts_pct, t.cart_within_1s_after_view, t.cart_before_or_without_view,
        {pct('t.converting_same_ts','t.converting_sessions')} AS conv_same_ts_pct FROM @ttc t, (SELECT * FROM @eq WHERE event_name='view_item') v, (SELECT * FROM @eq WHERE event_name='add_to_cart') a""",
        "vi_avg_items vi_multi_pct vi_no_item_pct atc_avg_items atc_one_pct cart_same_ts_pct conv_same_ts_pct"),
    "time_to_convert": ("SELECT * FROM @ttc", "p50_s_to_v p50_v_to_c p50_c_to_k p50_k_to_p p50_total"),
    # channels and devices
    "channel_table": ("SELECT * FROM @ch", "revenue share view_pct cart_from_view purch_pct rev_per_session"),
    "medium_agreement": (f"SELECT {total('sessions')} AS sessions, {total('CASE WHEN session_medium=first_touch_medium THEN sessions ELSE 0 END')} AS agreeing, {pct('sum(CASE WHEN session_medium=first_touch_medium THEN sessions ELSE 0 END)','sum(sessions)')} AS agreement_pct FROM @cnt", "agreement_pct"),
    "medium_crosstab": ("SELECT first_touch_medium, session_medium, CAST(sum(sessions) AS BIGINT) AS sessions FROM @cnt GROUP BY 1,2", ""),
    "device_table": (f"""SELECT device_category, sessions, purchase, {pct('sessions','(SELECT sum(sessions) FROM @dev)')} AS share, {pct('view_item','sessions')} AS view_pct, {pct('add_to_cart','sessions')} AS cart_pct,
        {pct('purchase','sessions')} AS purch_pct, {_w['purchase'][0]} AS ci_lo, {_w['purchase'][1]} AS ci_hi,
        (SELECT round_even(max({pct('purchase','sessions')})-min({pct('purchase','sessions')}),2) FROM @dev) AS gap_pp,
        device_category=(SELECT device_category FROM @dev ORDER BY {pct('purchase','sessions')} DESC, sessions DESC, device_category LIMIT 1) AS is_top, t.*
        FROM @dev, ({chi2_cte('SELECT * FROM @dev','purchase','sessions')}) t""", f"share view_pct cart_pct purch_pct ci_lo ci_hi gap_pp {_TEST}"),
    "device_steps": (_device_steps(), "pct"),
    "channel_verdict": (f"""SELECT b.channel AS best_channel, b.view_pct AS best_view_pct, w.channel AS worst_channel, w.view_pct AS worst_view_pct, b.view_pct-w.view_pct AS spread_pp,
        CASE WHEN b.view_pct-w.view_pct>=10 THEN 'driver' WHEN b.view_pct-w.view_pct>=7 THEN 'borderline' ELSE 'uniform' END AS verdict, t.chi2, t.dof, t.p, t.cramers_v,
        r.channel AS top_rev_channel, r.rev_per_session AS top_rev_per_session, coalesce((SELECT max(share) FROM @ch WHERE channel='(not set)'),0) AS notset_share, (SELECT max(view_pct) FROM @ch WHERE channel='(not set)') AS notset_view_pct
        FROM (SELECT * FROM @chn ORDER BY view_pct DESC, sessions DESC, channel LIMIT 1) b, (SELECT * FROM @chn ORDER BY view_pct, sessions DESC, channel LIMIT 1) w,
        ({chi2_cte('SELECT * FROM @chn','view_item','sessions')}) t LEFT JOIN (SELECT * FROM @chn WHERE NOT low_n ORDER BY rev_per_session DESC, sessions DESC, channel LIMIT 1) r ON true""",
        f"best_view_pct worst_view_pct spread_pp {_TEST} top_rev_per_session notset_share notset_view_pct"),
    "segment_rows": (_spread("@cty", "country"), "share rate"),
    "segment_spread": (f"""SELECT (SELECT CAST(count(*) AS BIGINT) FROM @seg) AS n_segments, b.country AS best, b.rate AS best_rate, w.country AS worst, w.rate AS worst_rate, b.rate-w.rate AS spread_pp, t.chi2, t.dof, t.p, t.cramers_v,
        CASE WHEN b.rate-w.rate>=10 THEN 'driver' WHEN b.rate-w.rate>=7 THEN 'borderline' ELSE 'uniform' END AS verdict FROM (SELECT * FROM @seg ORDER BY rate DESC, country LIMIT 1) b,
        (SELECT * FROM @seg ORDER BY rate, country DESC LIMIT 1) w, ({chi2_cte('SELECT * FROM @seg','view_item','sessions')}) t""", f"best_rate worst_rate spread_pp {_TEST}"),
    # landing pages
    "landing_pages": ("SELECT * FROM @lan", ""),
    "weak_landing_pages": ("SELECT * FROM @weak", "share view_pct site_view_pct gap_pp"),
    "landing_diagnosis": ("SELECT * FROM @dia", "eng_s_total"),
    "tracking_gaps": ("SELECT * FROM @gap", "working_rate rate_in rate_out scroll_in scroll_out"),
    "landing_verdict": ("SELECT * FROM @ver", "landed_rate inside_rate landed_untagged_pct landed_eng_s inside_eng_s working_rate scroll_in scroll_out"),
    # catalogue
    "listing_pages": ("SELECT * FROM @lp", "median_price"),
    "listing_coverage": (f"""SELECT {total('n_source_labels')} AS raw_labels, CAST(count(*) AS BIGINT) AS labels, {count_if('n_source_labels>1')} AS merged_groups,
        coalesce({pct("sum(CASE WHEN item_category='(not set)' THEN viewing_sessions ELSE 0 END)",'sum(viewing_sessions)')},0) AS notset_share,
        {count_if("item_category<>'(not set)' AND viewing_sessions<100")} AS left_out, """ + ", ".join(
        f"""CAST(count(*) FILTER (WHERE item_category<>'(not set)' AND viewing_sessions>=100 AND level='{x}') AS BIGINT) AS {x.replace(' ', '_')}_pages""" for x in ("product type", "brand", "collection", "parent")) + " FROM @lv", "notset_share"),
    "category_overlap": ("SELECT * FROM @ovl", ""),
    "overlap_summary": ("SELECT i.items, i.multi, e.item_name AS example_item, e.n_categories AS example_n, e.categories AS example_categories FROM (SELECT CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (WHERE n_categories>1) AS BIGINT) AS multi FROM @ovl) i LEFT JOIN (SELECT * FROM @ovl WHERE n_categories>1 ORDER BY sightings DESC, item_name LIMIT 1) e ON true", ""),
    "price_bands": ("SELECT * FROM @pb", ""),
    "listing_levels": ("SELECT * FROM @lv", "median_price"),
    "site_average": (f"SELECT coalesce({pct('sum(carting_sessions)','sum(viewing_sessions)')},0) AS average_pct FROM @lp", "average_pct"),
    "flag_categories": (f"""SELECT item_category, viewing_sessions, carting_sessions, atc_pct, ci_lo, ci_hi, average_pct, CASE WHEN ci_hi<average_pct THEN 'below' WHEN ci_lo>average_pct THEN 'above' ELSE 'neutral' END AS status,
        CASE WHEN ci_hi<average_pct THEN CAST(round_even((average_pct-atc_pct)/100*viewing_sessions,0) AS BIGINT) ELSE 0 END AS carts_at_stake FROM (SELECT item_category, viewing_sessions, carting_sessions,
        {pct('carting_sessions','viewing_sessions')} AS atc_pct, {_w['cart'][0]} AS ci_lo, {_w['cart'][1]} AS ci_hi, {pct('(SELECT sum(carting_sessions) FROM @pb)','(SELECT sum(viewing_sessions) FROM @pb)')} AS average_pct FROM @lp)""", "atc_pct ci_lo ci_hi average_pct"),
    "category_ranking": ("SELECT * FROM @rk", "atc_pct median_price ci_lo ci_hi average_pct"),
    "listing_other": (f"SELECT item_category, level, viewing_sessions, carting_sessions, atc_pct, {_w['cart'][0]} AS ci_lo, {_w['cart'][1]} AS ci_hi FROM @li WHERE level<>'product type'", "atc_pct ci_lo ci_hi"),
    "category_targets": ("SELECT item_category, carts_at_stake, atc_pct FROM @top", "atc_pct"),
    "category_summary": (f"""SELECT CAST(count(*) AS BIGINT) AS categories, {count_if("status='below'")} AS below, {count_if("status='above'")} AS above, {count_if("status='neutral'")} AS neutral,
        CAST(coalesce(sum(carts_at_stake),0) AS BIGINT) AS total_at_stake, min(atc_pct) AS rate_min, max(atc_pct) AS rate_max, quantile_cont(median_price,0.5) FILTER (WHERE status='below') AS flagged_median_price,
        quantile_cont(median_price,0.5) FILTER (WHERE status<>'below') AS other_median_price, (SELECT CAST(coalesce(sum(carts_at_stake),0) AS BIGINT) FROM @top) AS top_at_stake FROM @rk""", "rate_min rate_max flagged_median_price other_median_price"),
    "price_rank_corr": (_SPEARMAN, "rho p"),
    "price_band_test": (f"""SELECT o.i AS band_order, o.b AS price_band, viewing_sessions, carting_sessions, {pct('carting_sessions','viewing_sessions')} AS atc_pct, {_w['cart'][0]} AS ci_lo, {_w['cart'][1]} AS ci_hi,
        o.b=(SELECT x.b FROM {_values(_BANDS)} x(i,b) JOIN @pb y ON y.price_band=x.b ORDER BY {pct('carting_sessions','viewing_sessions')} DESC, x.i LIMIT 1) AS is_best,
        o.b=(SELECT x.b FROM {_values(_BANDS)} x(i,b) JOIN @pb y ON y.price_band=x.b ORDER BY {pct('carting_sessions','viewing_sessions')}, x.i LIMIT 1) AS is_worst, t.*
        FROM {_values(_BANDS)} o(i,b) JOIN @pb z ON z.price_band=o.b, ({chi2_cte('SELECT * FROM @pb','carting_sessions','viewing_sessions')}) t""", f"atc_pct ci_lo ci_hi {_TEST}"),
    # retention
    "cohorts": ("SELECT * FROM @coh", ""),
    "retention_matrix": ("SELECT * FROM @mx", "retention_pct"),
    "cohort_eligibility": ("SELECT * FROM @cce", ""),
    "retention_averages": (f"""SELECT round(avg(retention_pct) FILTER (WHERE weeks_since_cohort=1),1) AS avg_wk1, round(avg(retention_pct) FILTER (WHERE weeks_since_cohort=2),1) AS avg_wk2,
        {count_if('weeks_since_cohort=1 AND retention_pct IS NOT NULL')} AS cohorts_wk1 FROM @mx WHERE cohort_week>=DATE '1995-01-01'""", "avg_wk1 avg_wk2"),
    "retention_by_month": ("SELECT month, lo, hi, n, mean AS mean_pct, month=(SELECT month FROM @rm ORDER BY mean DESC, month LIMIT 1) AS is_peak, month=(SELECT month FROM @rm ORDER BY mean, month LIMIT 1) AS is_trough FROM @rm", "lo hi mean_pct"),
    "cohort_channel": ("SELECT * FROM @cc", ""),
    "retention_mix": (_mix("@pk", "@tr"), "rate_a rate_b rate_b_at_a_mix change_pp within_pp mix_pp mix_share_pct"),
    "mix_decomposition": (_mix("@pk", "@tr"), "rate_a rate_b rate_b_at_a_mix change_pp within_pp mix_pp mix_share_pct"),
    "channel_changes": (_changes("@pk", "@tr"), "rate_a rate_b"),
    "channels_fell": (f"""SELECT CAST(count(*) AS BIGINT) AS channels_n, {count_if('fell')} AS channels_fell, coalesce((SELECT string_agg(medium, ', '
        ORDER BY base_a DESC, medium) FROM (SELECT * FROM ({_changes('@pk', '@tr')}) WHERE fell ORDER BY base_a DESC, medium LIMIT 3)), '') AS examples
        FROM ({_changes('@pk', '@tr')})""", ""),
    # cross-session
    "user_sessions": ("SELECT user_pseudo_id, session_id, ts_s, ts_v, ts_c, ts_k, ts_p, revenue, s1, s2, s3, s4, s5, t0, rn, prev_cart_ts, prev_cart_rn, next_purchase_ts, window_end_ts FROM @us", "revenue"),
    "purchase_paths": ("SELECT * FROM @pp", "revenue hours_since_cart"),
    "cart_recovery": ("SELECT * FROM @cr", "hours_to_next_purchase hours_left"),
    "purchase_path_summary": (f"""SELECT o.i AS path_order, o.b AS path, coalesce(n,0) AS sessions, coalesce(r,0) AS revenue, coalesce({pct('n','(SELECT count(*) FROM @pp)')},0) AS share_pct, h AS median_hours_since_cart, m AS median_sessions_since_cart
        FROM {_values(PATHS)} o(i,b) LEFT JOIN (SELECT path, CAST(count(*) AS BIGINT) AS n, round(sum(revenue),2) AS r, quantile_cont(hours_since_cart,0.5) AS h, quantile_cont(CAST(sessions_since_cart AS DOUBLE),0.5) AS m FROM @pp GROUP BY 1) z ON z.path=o.b""",
        "revenue share_pct median_hours_since_cart median_sessions_since_cart"),
    "recovery_curve": (f"""SELECT days, eligible_carts, recovered, {pct('recovered','eligible_carts')} AS recovered_pct, {_w['rec'][0]} AS ci_lo, {_w['rec'][1]} AS ci_hi FROM (SELECT days, CAST(count(*) AS BIGINT) AS eligible_carts,
        {count_if('hours_to_next_purchase<=days*24')} AS recovered FROM @cr, (VALUES (CAST(1 AS BIGINT)),(7),(14)) v(days) WHERE hours_left>=days*24 GROUP BY 1)""", "recovered_pct ci_lo ci_hi"),
    # statistics
    "wilson_ci": (f"SELECT country, sessions, purchase, {_w['purchase'][0]} AS ci_lo, {_w['purchase'][1]} AS ci_hi FROM @cty", "ci_lo ci_hi"),
    "diff_ci": (f"SELECT c.country, {_d[0]} AS diff_pp, {_d[1]} AS ci_lo, {_d[2]} AS ci_hi FROM @cty c, @fun f", "diff_pp ci_lo ci_hi"),
    "chi_square": (chi2_cte("SELECT * FROM @cnt", "view_item", "sessions", "first_touch_medium"), _TEST),
    "compare_periods": (_compare(), "current_pct previous_pct change_pp ci_lo ci_hi"),
    "stats_tests": (chi2_cte("SELECT * FROM @tst0", "k", "n", "test"), _TEST),
    # sizing
    "opportunity_lift": (_lift(), "extra_revenue"),
    "landing_sizing": (_LANDING_SIZING, "weak_share lost_share untagged_pct new_pct entry_inside_lo entry_inside_hi entry_untagged_pct entry_landed_eng_s entry_inside_eng_s revenue_low revenue_high"),
    "cart_recovery_sizing": (_CART_SIZING, "revenue checkout_target_pct"),
    "reengagement_sizing": (_REENGAGE, "revenue_low revenue_high"),
    "catalogue_sizing": (_CATALOGUE, "revenue_low revenue_high"),
    "recommendations": (f"""SELECT CAST(1 AS BIGINT) AS priority, 'show products on weak landing pages' AS action, orders, revenue_low, revenue_high, 'new product views buy at half to all of the current rate' AS assumption FROM ({_LANDING_SIZING})
        UNION ALL SELECT 2, 'win back carts', orders, revenue, revenue, 'one left cart in ten goes on to checkout' FROM ({_CART_SIZING})
        UNION ALL SELECT 2, 'bring users back', NULL, revenue_low, revenue_high, 'eight percent return in the week after, once each' FROM ({_REENGAGE})
        UNION ALL SELECT 3, 'review listings: '||targets, orders, revenue_low, revenue_high, 'new carts buy like current ones at most' FROM ({_CATALOGUE})""", "revenue_low revenue_high"),
    "priority_label": (f"""SELECT round_even({pct('view_item','sessions')},1) AS view_rate, round_even({pct('add_to_cart','view_item')},1) AS cart_rate, CASE WHEN round_even({pct('view_item','sessions')},1)<30 THEN 'Top-of-Funnel: Product Discovery'
        WHEN round_even({pct('add_to_cart','view_item')},1)<40 THEN 'Mid-Funnel: Product → Cart Conversion' ELSE 'Retention & Lifecycle' END AS priority FROM @tot""", "view_rate cart_rate"),
    # exports
    "fct_sessions": ("SELECT * FROM @fct", "revenue minutes_to_purchase"),
    "fct_session_listing": ("SELECT uid||'-'||CAST(sid AS VARCHAR) AS session_key, item_category, coalesce(lc>=fv,false) AS carted_after_view FROM @sc WHERE fv IS NOT NULL", ""),
    "fct_session_price_band": ("SELECT uid||'-'||CAST(sid AS VARCHAR) AS session_key, price_band, coalesce(lc>=fv,false) AS carted_after_view FROM @sb WHERE fv IS NOT NULL", ""),
    "dim_users": ("SELECT uid AS user_pseudo_id, cohort_week FROM @fs", ""),
    "fct_user_activity": ("SELECT uid AS user_pseudo_id, wk AS activity_week FROM @act", ""),
    "dim_price_band": (f"SELECT o.i AS band_order, o.b AS price_band, coalesce(viewing_sessions,0) AS viewing_sessions FROM {_values(_BANDS)} o(i,b) LEFT JOIN @pb z ON z.price_band=o.b", ""),
    "dim_listing": ("SELECT item_category, parent_node, n_source_labels, source_labels, median_price, level, level='product type' AND item_category<>'(not set)' AND viewing_sessions>=100 AS ranked FROM @lv", "median_price"),
    "landing_diagnosis_table": ("SELECT page_path AS landing_page, verdict AS diagnosis, landed_rate AS landed_rate_pct, inside_rate AS inside_rate_pct, landed_untagged_pct, CAST(gap_start AS DATE) AS gap_from, CAST(gap_end AS DATE)+6 AS gap_to FROM @ver", "landed_rate_pct inside_rate_pct landed_untagged_pct"),
    "reconcile": ("""SELECT *, actual=expected AS ok FROM (SELECT 'sessions' AS "check", (SELECT CAST(count(*) AS BIGINT) FROM @fct) AS actual, sessions AS expected FROM @fun
        UNION ALL SELECT 'view_item', (SELECT count(*) FROM @fct WHERE saw_product), view_item FROM @fun UNION ALL SELECT 'add_to_cart', (SELECT count(*) FROM @fct WHERE added_to_cart), add_to_cart FROM @fun
        UNION ALL SELECT 'begin_checkout', (SELECT count(*) FROM @fct WHERE began_checkout), begin_checkout FROM @fun UNION ALL SELECT 'purchase', (SELECT count(*) FROM @fct WHERE purchased), purchase FROM @fun
        UNION ALL SELECT 'channel sessions', (SELECT CAST(sum(sessions) AS BIGINT) FROM @cnt), sessions FROM @fun UNION ALL SELECT 'quality sessions', (SELECT CAST(sum(sessions) AS BIGINT) FROM @sq WHERE cut='all'), sessions FROM @fun
        UNION ALL SELECT 'revenue purchases', (SELECT purchasing_sessions FROM @rv), purchase FROM @fun)""", ""),
}

CTE["dsh"] = f"SELECT {pct('sum(sessions) FILTER (WHERE NOT attributed)', 'sum(sessions)')} AS x FROM @sq WHERE cut='device' GROUP BY dev"
CTE["seg"] = _spread("@cty", "country")
CTE["ovl"] = """SELECT item_name, CAST(count(*) AS BIGINT) AS sightings, CAST(count(DISTINCT item_category) AS BIGINT) AS n_categories,
    string_agg(DISTINCT item_category, ' · ' ORDER BY item_category) AS categories FROM @itl WHERE name='view_item' AND item_name IS NOT NULL AND item_category<>'(not set)' GROUP BY 1"""
CTE["devh"] = """SELECT device_category, """ + COUNTS + """ FROM @ss WHERE s1 AND session_date<=DATE '2024-01-15' GROUP BY 1"""


#: The statement behind each section of the findings.
SECTIONS = {
    "session_funnel": "funnel_rates", "step_losses": "step_losses", "revenue": "revenue_summary", "revenue_reconcile": "revenue_reconcile",
    "time_to_convert": "time_to_convert", "devices": "device_table", "shoppers_funnel": "shoppers_funnel", "retention": "retention_averages",
    "retention_months": "retention_by_month", "retention_mix": "retention_mix", "channels": "channel_table", "channel_verdict": "channel_verdict",
    "categories": "category_ranking", "category_summary": "category_summary", "other_listings": "listing_other", "price_bands": "price_band_test",
    "price_correlation": "price_rank_corr", "landing_pages": "weak_landing_pages", "landing_verdicts": "landing_verdict",
    "untagged": "untagged_overall", "visitors": "new_vs_returning", "recommendations": "recommendations", "priority": "priority_label",
    "segments": "funnel_segments", "events": "event_inventory", "unique_users": "unique_users", "event_quality": "event_quality_rates",
    "session_starts": "session_start_check", "untagged_profile": "untagged_profile", "sensitivity": "sensitivity_funnel",
    "medium_agreement": "medium_agreement", "device_steps": "device_steps", "tracking_gaps": "tracking_gaps",
    "listing_coverage": "listing_coverage", "product_overlap": "overlap_summary", "channel_changes": "channel_changes",
    "channels_fell": "channels_fell", "purchase_paths": "purchase_path_summary", "cart_recovery": "recovery_curve", "tests": "stats_tests",
}


def _section(section: str, name: str) -> str:
    """The rows of a statement, one a column: through JSON, whose types tell numbers from texts."""
    number = "e.type IN ('UBIGINT','BIGINT','HUGEINT','DOUBLE')"
    return f"""SELECT '{section}' AS section, coalesce(nullif((SELECT string_agg(k.value->>'$', ' · ' ORDER BY k.key) FILTER (WHERE k.type='VARCHAR') FROM json_each(t.j) k), ''), 'all') AS item,
        e.key AS metric, CASE WHEN {number} THEN round(CAST(e.value AS DOUBLE),6)+0 END AS number, CASE WHEN NOT {number} THEN e.value->>'$' END AS "text"
        FROM (SELECT to_json(s) AS j FROM ({STATEMENTS[name][0]}) s) t, json_each(t.j) e"""


def oracle_sql() -> dict[str, str]:
    found = {name: statement(select, doubles) for name, (select, doubles) in STATEMENTS.items()}
    return found | {"findings": statement(" UNION ALL ".join(f"({_section(*pair)})" for pair in SECTIONS.items()))}
