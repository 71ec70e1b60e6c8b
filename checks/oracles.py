"""The registered queries as independent SQL for DuckDB.

Every entry is one statement over the driver's tables. Common steps are kept as named CTEs and each
statement pulls in just those it mentions. Counts are BIGINT, ratios DOUBLE rounded to six decimals.
"""

from __future__ import annotations

import re

Z = "1.959963984540054"


def wilson(k: str, n: str) -> tuple[str, str]:
    """Wilson bounds in percent as SQL text."""
    zz = f"({Z}*{Z})"
    nn = f"nullif(CAST({n} AS DOUBLE),0)"
    p = f"(CAST({k} AS DOUBLE)/{nn})"
    half = f"{Z}*sqrt({p}*(1-{p})/{nn}+{zz}/(4*{nn}*{nn}))/(1+{zz}/{nn})"
    centre = f"(({p}+{zz}/(2*{nn}))/(1+{zz}/{nn}))"
    return f"(({centre}-{half})*100)", f"(({centre}+{half})*100)"


def pct(k: str, n: str) -> str:
    return f"(CAST({k} AS DOUBLE)/nullif(CAST({n} AS DOUBLE),0)*100)"


def ratio(k: str, n: str) -> str:
    return f"(CAST({k} AS DOUBLE)/nullif(CAST({n} AS DOUBLE),0))"


def count_if(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def total(expr: str) -> str:
    return f"CAST(sum({expr}) AS BIGINT)"


def newcombe(k1, n1, k2, n2) -> tuple[str, str, str]:
    l1, u1 = wilson(k1, n1)
    l2, u2 = wilson(k2, n2)
    p1, p2 = ratio(k1, n1), ratio(k2, n2)
    d = f"({p1}-{p2})"
    lo = f"(({d}-sqrt(pow({p1}-{l1}/100,2)+pow({u2}/100-{p2},2)))*100)"
    hi = f"(({d}+sqrt(pow({u1}/100-{p1},2)+pow({p2}-{l2}/100,2)))*100)"
    return f"({d}*100)", lo, hi


def chi2_p(x: str, dof: str) -> str:
    """Upper tail by the lower-gamma power series: 1 − Σ exp((a+n) ln h − h − lnΓ(a+n+1))."""
    return (
        f"(CASE WHEN {x} IS NULL THEN NULL WHEN {dof} <= 0 OR {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - list_sum("
        f"list_transform(range(0, 400), lambda n: exp(({dof}/2.0+n)*ln({x}/2.0) - {x}/2.0 - lgamma({dof}/2.0+n+1))))) END)"
    )


def chi2_cte(rows: str, k: str, n: str, by: str = "") -> str:
    """chi2, dof, p, cramers_v of `rows` (optionally per `by`) as a SELECT."""
    b, pb, on = (f"{by},", f"PARTITION BY {by}", f"GROUP BY {by}") if by else ("", "", "")
    return (
        f"SELECT {b} chi2, dof, {chi2_p('chi2','dof')} AS p, sqrt(chi2/tot) AS cramers_v FROM ("
        f"SELECT {b} CASE WHEN min(n)>0 AND max(sk)>0 AND max(sk)<max(sn) THEN sum(pow(k-n*(sk/sn),2)/(n*(sk/sn)*(1-sk/sn))) END AS chi2,"
        f" CAST(count(*)-1 AS BIGINT) AS dof, max(sn) AS tot FROM ("
        f"SELECT {b} CAST({k} AS DOUBLE) AS k, CAST({n} AS DOUBLE) AS n, CAST(sum({k}) OVER ({pb}) AS DOUBLE) AS sk,"
        f" CAST(sum({n}) OVER ({pb}) AS DOUBLE) AS sn FROM ({rows})) {on})"
    )


LABEL = (
    "CASE WHEN raw='(not set)' THEN raw ELSE coalesce(nullif(trim(replace("
    "string_split(trim(replace(raw,' / ',' | '),'/'),'/')[-1],' | ',' / ')),''),'(not set)') END"
)
PARENT = (
    "CASE WHEN raw<>'(not set)' AND len(string_split(trim(replace(raw,' / ',' | '),'/'),'/'))>=2 THEN nullif(trim(replace("
    "string_split(trim(replace(raw,' / ',' | '),'/'),'/')[-2],' | ',' / ')),'') END"
)
BAND = (
    "CASE WHEN price IS NULL OR price<=0 THEN NULL WHEN price<10 THEN 'under $10' WHEN price<20 THEN '$10–20' "
    "WHEN price<30 THEN '$20–30' WHEN price<50 THEN '$30–50' ELSE '$50+' END"
)
SIZE = (
    "CASE WHEN n_events<=3 THEN '1–3' WHEN n_events<=5 THEN '4–5' WHEN n_events<=8 THEN '6–8' "
    "WHEN n_events<=15 THEN '9–15' ELSE '16+' END"
)
VISITOR = "CASE WHEN session_number=1 THEN 'new' WHEN session_number>1 THEN 'returning' ELSE 'unknown' END"
COUNTS = (
    "CAST(count(*) AS BIGINT) AS sessions, CAST(count(*) FILTER (WHERE s2) AS BIGINT) AS view_item, "
    "CAST(count(*) FILTER (WHERE s3) AS BIGINT) AS add_to_cart, CAST(count(*) FILTER (WHERE s4) AS BIGINT) AS begin_checkout, "
    "CAST(count(*) FILTER (WHERE s5) AS BIGINT) AS purchase"
)
REVENUE = "round(sum(CASE WHEN s5 THEN coalesce(revenue,0) ELSE 0 END),2) AS revenue"
# The four purchase paths.
PATHS = (
    "sequential, in one session",
    "carted in the session, out of order",
    "carted in an earlier session",
    "no cart seen in the window",
)
CUTS = {"all": ("attributed",), "size": ("size_bucket", "attributed"), "device": ("dev", "attributed"), "visitor": ("visitor",)}


def cut(name: str) -> str:
    """One grouping of the quality table; the dimensions it does not use are null."""
    used = CUTS[name]
    kinds = {"size_bucket": "VARCHAR", "dev": "VARCHAR", "attributed": "BOOLEAN", "visitor": "VARCHAR"}
    dims = ", ".join(d if d in used else f"CAST(NULL AS {t}) AS {d}" for d, t in kinds.items())
    return f"""SELECT '{name}' AS cut, {dims}, {COUNTS}, {REVENUE}, {count_if('n_page_view>0')} AS with_page_view,
        quantile_cont(CAST(engaged_s AS DOUBLE),0.5) AS median_engaged_s, CAST(quantile_disc(n_events,0.5) AS BIGINT) AS median_events
        FROM @qf GROUP BY {', '.join(used)}"""


RATES = ", ".join(
    [
        f"{pct('view_item','sessions')} AS view_pct",
        f"{pct('add_to_cart','view_item')} AS view_to_cart",
        f"{pct('begin_checkout','add_to_cart')} AS cart_to_checkout",
        f"{pct('purchase','begin_checkout')} AS checkout_to_purchase",
        f"{pct('purchase','sessions')} AS cvr",
        f"{ratio('revenue','sessions')} AS rev_per_session",
    ]
)
RATE_COLUMNS = "view_pct view_to_cart cart_to_checkout checkout_to_purchase cvr rev_per_session"

# Named steps -----------------------------------------------------------------

CTE: dict[str, str] = {
    # the event stream cut into sessions, event by event
    "e0": """SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value,
        CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events""",
    "e1": """SELECT *, CASE WHEN lag(us) OVER w IS NULL OR us-lag(us) OVER w > 43200000000 THEN 1 ELSE 0 END AS opens
        FROM @e0 WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)""",
    "e2": """SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sno
        FROM @e1""",
    "e3": """SELECT *, first_value(us) OVER w AS first_us, row_number() OVER w AS pos
        FROM @e2 WINDOW w AS (PARTITION BY user_id, sno ORDER BY us, event_id)""",
    "e4": """SELECT e3.*, p.url FROM @e3 CROSS JOIN (SELECT count(*) AS np FROM pages) LEFT JOIN pages p
        ON p.page_id = (k*k*np)//10000""",
    "e5": """SELECT *, 'session_start' AS name, false AS own FROM @e4 WHERE pos=1
        UNION ALL SELECT *, 'page_view', false FROM @e4 WHERE pos=1 OR event_id%2=0
        UNION ALL SELECT *, CASE event_type WHEN 'view' THEN 'view_item' WHEN 'click' THEN 'add_to_cart'
          WHEN 'signup' THEN 'begin_checkout' WHEN 'purchase' THEN 'purchase' WHEN 'error' THEN 'scroll' END, true FROM @e4""",
    "ev": """SELECT event_id, k, own, user_id, CAST(make_timestamp(us) AS DATE) AS d, strftime(make_timestamp(us),'%Y%m%d') AS event_date,
        us AS ts, name, CAST(user_id AS VARCHAR) AS uid, first_us//1000000 AS sid, sno AS session_number, url,
        CASE WHEN own AND k%3=0 THEN ['organic','cpc','referral','(none)','email'][(k//3)%5+1] END AS medium,
        CASE WHEN own THEN CAST(round(value*1000) AS BIGINT) END AS eng,
        regexp_replace(regexp_replace(url,'^https?://[^/]+',''),'[?#].*$','') AS path,
        ['desktop','mobile','tablet'][user_id%3+1] AS device,
        CASE WHEN user_id%10=0 THEN '' ELSE n_name END AS country,
        ['organic','cpc','(none)'][user_id%3+1] AS first_touch,
        CASE WHEN name='purchase' AND k%10<>0 THEN value END AS rev,
        CASE WHEN own AND name IN ('view_item','add_to_cart') AND k%4>0 THEN k%4 END AS n_items,
        CASE WHEN own AND name='add_to_cart' AND k%4>0 AND (p_type<>'STANDARD' OR (user_id//16)%2=0) THEN 1 ELSE 0 END AS n_carted
        FROM @e5 LEFT JOIN nation ON n_nationkey = user_id%25
        CROSS JOIN (SELECT count(*) AS np FROM part) LEFT JOIN part ON p_partkey = (user_id*7)%np""",
    "it": """SELECT x.*, p_name AS item_name, CAST(p_size AS DOUBLE) AS price,
        CASE p_partkey%3 WHEN 0 THEN 'Home/'||p_type||'/' WHEN 1 THEN 'Home/Apparel/'||p_type||'/' ELSE p_type END AS raw,
        CASE WHEN j=0 THEN n_carted ELSE 0 END AS qty
        FROM (SELECT ev.*, unnest(range(0, n_items)) AS j FROM @ev WHERE n_items IS NOT NULL) x
        CROSS JOIN (SELECT count(*) AS np FROM part) JOIN part ON p_partkey = (user_id*7+j)%np""",
    "itl": f"SELECT *, {LABEL} AS item_category, {PARENT} AS parent, {BAND} AS price_band FROM @it",
    # sessions
    "base": """SELECT uid AS user_pseudo_id, sid AS session_id,
        min(ts) FILTER (WHERE name='session_start') AS ts_s, min(ts) FILTER (WHERE name='view_item') AS ts_v,
        min(ts) FILTER (WHERE name='add_to_cart') AS ts_c, min(ts) FILTER (WHERE name='begin_checkout') AS ts_k,
        min(ts) FILTER (WHERE name='purchase') AS ts_p, min(device) AS device_category, min(first_touch) AS first_touch_medium,
        min(nullif(nullif(country,''),'(not set)')) AS country, sum(rev) FILTER (WHERE name='purchase') AS revenue,
        first(medium ORDER BY ts, medium) FILTER (WHERE medium IS NOT NULL) AS session_medium,
        CAST(count(*) AS BIGINT) AS n_events, CAST(count(medium) AS BIGINT) AS n_medium,
        CAST(count(*) FILTER (WHERE name='page_view') AS BIGINT) AS n_page_view,
        sum(coalesce(eng,0))/1000 AS engaged_s, max(session_number) AS session_number,
        first(path ORDER BY ts, path) FILTER (WHERE name='page_view' AND path IS NOT NULL) AS landing_page,
        min(d) AS session_date FROM @ev GROUP BY uid, sid""",
    "ss": """SELECT *, ts_s IS NOT NULL AS s1, coalesce(ts_s IS NOT NULL AND ts_v>=ts_s,false) AS s2,
        coalesce(ts_s IS NOT NULL AND ts_v>=ts_s AND ts_c>=ts_v,false) AS s3,
        coalesce(ts_s IS NOT NULL AND ts_v>=ts_s AND ts_c>=ts_v AND ts_k>=ts_c,false) AS s4,
        coalesce(ts_s IS NOT NULL AND ts_v>=ts_s AND ts_c>=ts_v AND ts_k>=ts_c AND ts_p>=ts_k,false) AS s5
        FROM @base WHERE coalesce(ts_s,ts_v,ts_c,ts_k,ts_p) IS NOT NULL""",
    "fun": f"SELECT {COUNTS} FROM @ss WHERE s1",
    "dev": f"SELECT device_category, {COUNTS} FROM @ss WHERE s1 GROUP BY 1",
    "cty": f"SELECT coalesce(country,'(not set)') AS country, {COUNTS}, {REVENUE} FROM @ss WHERE s1 GROUP BY 1",
    "cnt": f"""SELECT coalesce(session_medium,'(not set)') AS session_medium, coalesce(first_touch_medium,'(not set)') AS first_touch_medium,
        {COUNTS}, {REVENUE} FROM @ss WHERE s1 GROUP BY 1,2""",
    # revenue
    "rv": """SELECT CAST(count(*) FILTER (WHERE s5) AS BIGINT) AS purchasing_sessions,
        CAST(count(*) FILTER (WHERE s5 AND revenue>0) AS BIGINT) AS orders_with_revenue,
        round(sum(revenue) FILTER (WHERE s5),2) AS total_revenue,
        round(avg(revenue) FILTER (WHERE s5 AND revenue>0),2) AS avg_order_value,
        round(quantile_cont(revenue,0.5) FILTER (WHERE s5 AND revenue>0),2) AS median_order_value,
        round(min(revenue) FILTER (WHERE s5 AND revenue>0),2) AS min_order_value,
        round(max(revenue) FILTER (WHERE s5 AND revenue>0),2) AS max_order_value,
        CAST(count(*) AS BIGINT) AS all_purchasing_sessions, round(sum(revenue),2) AS all_revenue,
        CAST(count(*) FILTER (WHERE ts_c IS NULL) AS BIGINT) AS purchases_without_cart FROM @ss WHERE ts_p IS NOT NULL""",
    "tot": "SELECT fun.*, rv.total_revenue FROM @fun, @rv",
    "ttc": f"""SELECT c.*, k.* FROM (SELECT
        round(quantile_cont((ts_v-ts_s)/CAST(6e7 AS DOUBLE),0.5),1) AS p50_s_to_v, round(quantile_cont((ts_c-ts_v)/CAST(6e7 AS DOUBLE),0.5),1) AS p50_v_to_c,
        round(quantile_cont((ts_k-ts_c)/CAST(6e7 AS DOUBLE),0.5),1) AS p50_c_to_k, round(quantile_cont((ts_p-ts_k)/CAST(6e7 AS DOUBLE),0.5),1) AS p50_k_to_p,
        round(quantile_cont((ts_p-ts_s)/CAST(6e7 AS DOUBLE),0.5),1) AS p50_total, CAST(count(*) AS BIGINT) AS converting_sessions,
        {count_if('ts_c=ts_v')} AS converting_same_ts FROM @ss WHERE s5) c, (SELECT CAST(count(*) AS BIGINT) AS carting_sessions,
        {count_if('ts_c=ts_v')} AS cart_same_ts_as_view, {count_if('ts_v IS NULL OR ts_c<ts_v')} AS cart_before_or_without_view,
        {count_if('ts_c>ts_v AND ts_c-ts_v<1000000')} AS cart_within_1s_after_view FROM @ss WHERE ts_c IS NOT NULL) k""",
    # quality
    "qf": f"SELECT *, n_medium>0 AS attributed, {VISITOR} AS visitor, {SIZE} AS size_bucket, device_category AS dev FROM @ss WHERE s1",
    "sq": None,
    "vis": "SELECT * FROM @sq WHERE cut='visitor' AND visitor IN ('new','returning')",
    "nvr": None,
    "eq": f"""SELECT name AS event_name, CAST(count(*) AS BIGINT) AS events, round(avg(n_items),1) AS avg_items,
        {count_if('n_items>1')} AS multi_item_events, {count_if('coalesce(n_items,0)=0')} AS no_item_events,
        {count_if("n_carted=1")} AS one_carted_item_events
        FROM @ev WHERE name IN ('view_item','add_to_cart') GROUP BY 1""",
    # channels
    "chb": """SELECT CASE WHEN 1-(SELECT coalesce(sum(sessions) FILTER (WHERE session_medium='(not set)'),0)/sum(sessions) FROM @cnt)>=0.5
        THEN 'session_medium' ELSE 'first_touch_medium' END AS basis""",
    "ch0": """SELECT CASE WHEN basis='session_medium' THEN session_medium ELSE first_touch_medium END AS channel, basis, sum(sessions) AS sessions,
        sum(view_item) AS view_item, sum(add_to_cart) AS add_to_cart, sum(purchase) AS purchase, sum(revenue) AS revenue
        FROM @cnt, @chb GROUP BY 1,2""",
    "ch1": "SELECT *, sessions/(SELECT sum(sessions) FROM @ch0)<0.01 AS small FROM @ch0",
    "ch2": """SELECT CASE WHEN small AND (SELECT count(*) FILTER (WHERE small) FROM @ch1)>1 THEN 'other ('||(SELECT count(*) FILTER (WHERE small) FROM @ch1)||' small channels)'
        ELSE channel END AS channel, basis, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(view_item) AS BIGINT) AS view_item,
        CAST(sum(add_to_cart) AS BIGINT) AS add_to_cart, CAST(sum(purchase) AS BIGINT) AS purchase, round(sum(revenue),2) AS revenue FROM @ch1 GROUP BY 1,2""",
    "ch": f"""SELECT channel, sessions, view_item, add_to_cart, purchase, revenue, {pct('sessions','(SELECT sum(sessions) FROM @ch2)')} AS share,
        {pct('view_item','sessions')} AS view_pct, {pct('add_to_cart','view_item')} AS cart_from_view, {pct('purchase','sessions')} AS purch_pct,
        {ratio('revenue','sessions')} AS rev_per_session, purchase<2 AS low_n, basis FROM @ch2""",
    "chn": "SELECT * FROM @ch WHERE NOT (starts_with(channel,'other (') OR starts_with(channel,'(not set)'))",
    # landing pages
    "lan": f"""SELECT coalesce(landing_page,'(no page_view)') AS landing_page, CAST(count(*) AS BIGINT) AS sessions, {count_if('s2')} AS view_item,
        {count_if('s5')} AS purchase, {count_if('session_number=1')} AS new_sessions, {count_if('n_medium=0')} AS unattributed_sessions
        FROM @ss WHERE s1 GROUP BY 1 HAVING count(*)>=20""",
    "weak": f"""SELECT *, CAST(round_even(gap_pp/100*sessions,0) AS BIGINT) AS extra_views FROM (SELECT l.*, {pct('l.sessions','f.sessions')} AS share,
        {pct('l.view_item','l.sessions')} AS view_pct, {pct('f.view_item','f.sessions')} AS site_view_pct,
        {pct('f.view_item','f.sessions')}-{pct('l.view_item','l.sessions')} AS gap_pp FROM @lan l, @fun f
        WHERE landing_page<>'(no page_view)' AND NOT regexp_matches(landing_page,
        '(?i)sign-?in|log-?in|register|my-?account|basket|cart|checkout|store-policies|faq')) WHERE share>=1.0 AND gap_pp>=5.0""",
    "hit": """SELECT uid, sid, path AS page_path, date_trunc('week',min(d)) AS week, bool_or(name='view_item') AS viewed, bool_or(name='scroll') AS scrolled,
        sum(coalesce(eng,0)) AS eng_ms FROM @ev WHERE path IN (SELECT landing_page FROM @weak) GROUP BY 1,2,3 HAVING bool_or(name='page_view')""",
    "dia": f"""SELECT page_path, CAST(week AS DATE) AS week, CASE WHEN landing_page=page_path THEN 'landed' ELSE 'inside' END AS entry, CAST(count(*) AS BIGINT) AS sessions,
        {count_if('viewed')} AS view_item_sessions, {count_if('scrolled')} AS scrolled_sessions, {count_if('n_medium=0')} AS untagged_sessions,
        ((sum(eng_ms)+50)//100)/CAST(10 AS DOUBLE) AS eng_s_total FROM @hit JOIN @base ON user_pseudo_id=uid AND session_id=sid GROUP BY 1,2,3""",
    "wk": f"""SELECT page_path, week, sum(sessions) AS n, sum(view_item_sessions) AS v, sum(scrolled_sessions) AS s,
        {pct('sum(view_item_sessions)','sum(sessions)')} AS rate FROM @dia GROUP BY 1,2 HAVING sum(sessions)>=5""",
    "bz": """SELECT w.*, working, rate<0.8*working AS silent, row_number() OVER (PARTITION BY page_path ORDER BY week) AS pos
        FROM @wk w JOIN (SELECT page_path, quantile_cont(rate,0.75) AS working FROM @wk GROUP BY 1 HAVING count(*)>2) USING (page_path)""",
    # a silent week's run starts after the last busy week that was not silent
    "run": """SELECT page_path, run, count(*) AS len, min(week) AS a, max(week) AS b FROM (
        SELECT *, coalesce(max(CASE WHEN NOT silent THEN pos END) OVER (PARTITION BY page_path ORDER BY pos ROWS UNBOUNDED PRECEDING),0) AS run FROM @bz)
        WHERE silent GROUP BY 1,2""",
    "best": "SELECT * FROM @run WHERE len>=2 QUALIFY row_number() OVER (PARTITION BY page_path ORDER BY len DESC, a)=1",
    "gap": f"""SELECT bz.page_path, a AS gap_start, b AS gap_end, CAST(len AS BIGINT) AS gap_weeks, working AS working_rate,
        {pct('sum(v) FILTER (WHERE week BETWEEN a AND b)','sum(n) FILTER (WHERE week BETWEEN a AND b)')} AS rate_in,
        {pct('sum(v) FILTER (WHERE week NOT BETWEEN a AND b)','sum(n) FILTER (WHERE week NOT BETWEEN a AND b)')} AS rate_out,
        {pct('sum(s) FILTER (WHERE week BETWEEN a AND b)','sum(n) FILTER (WHERE week BETWEEN a AND b)')} AS scroll_in,
        {pct('sum(s) FILTER (WHERE week NOT BETWEEN a AND b)','sum(n) FILTER (WHERE week NOT BETWEEN a AND b)')} AS scroll_out,
        CAST(sum(n) FILTER (WHERE week BETWEEN a AND b) AS BIGINT) AS sessions_in FROM @bz JOIN @best USING (page_path) GROUP BY 1,2,3,4,5""",
    "pr": """SELECT page_path, CAST(coalesce(sum(sessions) FILTER (WHERE entry='landed'),0) AS BIGINT) AS landed_sessions,
        CAST(coalesce(sum(sessions) FILTER (WHERE entry='inside'),0) AS BIGINT) AS inside_sessions,
        """
    + ", ".join(
        [
            f"""{pct(f"sum({c}) FILTER (WHERE entry='{e}')", f"sum(sessions) FILTER (WHERE entry='{e}')")} AS {a}"""
            for e, c, a in (
                ("landed", "view_item_sessions", "landed_rate"),
                ("inside", "view_item_sessions", "inside_rate"),
                ("landed", "untagged_sessions", "landed_untagged_pct"),
            )
        ]
    )
    + """, sum(eng_s_total) FILTER (WHERE entry='landed')/sum(sessions) FILTER (WHERE entry='landed') AS landed_eng_s,
        sum(eng_s_total) FILTER (WHERE entry='inside')/sum(sessions) FILTER (WHERE entry='inside') AS inside_eng_s FROM @dia GROUP BY 1""",
    "ver": f"""SELECT p.*, gap_start, gap_end, gap_weeks, working_rate, scroll_in, scroll_out,
        CASE WHEN gap_weeks IS NOT NULL AND scroll_in>=0.5*scroll_out THEN 'tracking'
        WHEN gap_weeks IS NOT NULL OR (inside_sessions>=20 AND inside_rate<{pct('f.view_item','f.sessions')}/2) THEN 'page'
        WHEN inside_sessions>=20 AND inside_rate>=landed_rate+10 THEN 'entry traffic' ELSE 'unclear' END AS verdict
        FROM @fun f, @pr p LEFT JOIN @gap USING (page_path)""",
    # catalogue
    "sc": """SELECT uid, sid, item_category, min(ts) FILTER (WHERE name='view_item') AS fv,
        max(ts) FILTER (WHERE name='add_to_cart' AND qty>0) AS lc FROM @itl GROUP BY 1,2,3""",
    "sb": """SELECT uid, sid, price_band, min(ts) FILTER (WHERE name='view_item') AS fv,
        max(ts) FILTER (WHERE name='add_to_cart' AND qty>0) AS lc FROM @itl WHERE price_band IS NOT NULL GROUP BY 1,2,3""",
    "lp": f"""SELECT a.item_category, viewing_sessions, carting_sessions, n_source_labels, source_labels, median_price, parent_node FROM
        (SELECT item_category, {count_if('fv IS NOT NULL')} AS viewing_sessions, {count_if('fv IS NOT NULL AND lc>=fv')} AS carting_sessions FROM @sc GROUP BY 1) a
        JOIN (SELECT item_category, CAST(count(DISTINCT raw) AS BIGINT) AS n_source_labels, string_agg(DISTINCT raw, ' · ' ORDER BY raw) AS source_labels FROM @itl GROUP BY 1) b USING (item_category)
        LEFT JOIN (SELECT item_category, quantile_cont(price,0.5) AS median_price FROM @itl WHERE name='view_item' AND price IS NOT NULL GROUP BY 1) c USING (item_category)
        LEFT JOIN (SELECT item_category, first(parent ORDER BY n DESC, parent) AS parent_node FROM (SELECT item_category, parent, count(*) AS n FROM @itl
          WHERE parent IS NOT NULL GROUP BY 1,2) GROUP BY 1) d USING (item_category)""",
    "lv": """SELECT lp.*, CASE WHEN item_category IN (SELECT parent_node FROM @lp WHERE parent_node IS NOT NULL) THEN 'parent'
        WHEN parent_node='Shop by Brand' THEN 'brand' WHEN parent_node='Home' THEN 'collection' ELSE 'product type' END AS level FROM @lp""",
    "li": f"""SELECT *, {pct('carting_sessions','viewing_sessions')} AS atc_pct FROM @lv WHERE item_category<>'(not set)' AND viewing_sessions>=100""",
    "avg1": f"SELECT coalesce({pct('sum(carting_sessions)','sum(viewing_sessions)')},0.0) AS average_pct FROM @li WHERE level='product type'",
    "rk": None,
    "top": "SELECT * FROM @rk WHERE carts_at_stake>0 ORDER BY carts_at_stake DESC, item_category LIMIT 3",
    "pb": f"SELECT price_band, {count_if('fv IS NOT NULL')} AS viewing_sessions, {count_if('fv IS NOT NULL AND lc>=fv')} AS carting_sessions FROM @sb GROUP BY 1",
    # cohorts, on orders
    "vo": """SELECT CAST(o_custkey AS VARCHAR) AS uid, o_orderkey AS sid, epoch_us(o_orderdate) AS ts, CAST(o_orderdate AS DATE) AS d,
        CAST(date_trunc('week',o_orderdate) AS DATE) AS wk, o_orderpriority AS medium FROM orders""",
    "fs": "SELECT uid, CAST(date_trunc('week',min(d)) AS DATE) AS cohort_week FROM @vo GROUP BY 1",
    "act": "SELECT DISTINCT uid, wk FROM @vo",
    "coh": """SELECT cohort_week, date_diff('day',cohort_week,wk)//7 AS weeks_since_cohort, CAST(count(DISTINCT uid) AS BIGINT) AS active_users
        FROM @fs JOIN @act USING (uid) WHERE wk>=cohort_week GROUP BY 1,2""",
    "mx0": """SELECT cohort_week, k AS weeks_since_cohort, CASE WHEN cohort_week+CAST(k*7+6 AS INTEGER)<=DATE '2001-08-01' THEN coalesce(active_users,0) END AS active_users
        FROM (SELECT DISTINCT cohort_week FROM @coh) CROSS JOIN (SELECT DISTINCT weeks_since_cohort AS k FROM @coh)
        LEFT JOIN @coh USING (cohort_week) WHERE coh.weeks_since_cohort=k OR coh.weeks_since_cohort IS NULL""",
    "mx": None,
    "rm": f"""SELECT strftime(cohort_week,'%Y-%m') AS month, round_even(min(retention_pct),1) AS lo, round_even(max(retention_pct),1) AS hi, CAST(count(*) AS BIGINT) AS n,
        avg(retention_pct) AS mean FROM @mx WHERE weeks_since_cohort=1 AND retention_pct IS NOT NULL AND cohort_week>=DATE '1995-01-01' GROUP BY 1""",
    "cc": f"""SELECT cohort_week, coalesce(medium,'(not set)') AS medium, CAST(count(*) AS BIGINT) AS users, {count_if('back')} AS wk1_users FROM (
        SELECT f.uid, f.wk AS cohort_week, f.medium, EXISTS (SELECT 1 FROM @act WHERE act.uid=f.uid AND act.wk=f.wk+7) AS back FROM (
          SELECT * FROM @vo QUALIFY row_number() OVER (PARTITION BY uid ORDER BY ts, sid)=1) f) GROUP BY 1,2""",
    "cce": """SELECT *, cohort_week>=DATE '1995-01-01' AS full_cohort, cohort_week+13<=DATE '2001-08-01' AS week1_observed FROM @cc""",
    "pk": """SELECT medium, sum(users) AS users, sum(wk1_users) AS successes FROM @cce WHERE full_cohort AND week1_observed
        AND strftime(cohort_week,'%Y-%m')=(SELECT month FROM @rm ORDER BY mean DESC, month LIMIT 1) GROUP BY 1""",
    "tr": """SELECT medium, sum(users) AS users, sum(wk1_users) AS successes FROM @cce WHERE full_cohort AND week1_observed
        AND strftime(cohort_week,'%Y-%m')=(SELECT month FROM @rm ORDER BY mean, month LIMIT 1) GROUP BY 1""",
    # cross-session paths
    "us0": """SELECT s.*, coalesce(ts_s,ts_v,ts_c,ts_k,ts_p) AS t0 FROM @ss s""",
    "us1": """SELECT a.*, (SELECT count(*)+1 FROM @us0 b WHERE b.user_pseudo_id=a.user_pseudo_id AND (b.t0,b.session_id)<(a.t0,a.session_id)) AS rn FROM @us0 a""",
    "us": """SELECT a.*, (SELECT max(b.ts_c) FROM @us1 b WHERE b.user_pseudo_id=a.user_pseudo_id AND b.rn<a.rn) AS prev_cart_ts,
        (SELECT max(b.rn) FROM @us1 b WHERE b.user_pseudo_id=a.user_pseudo_id AND b.rn<a.rn AND b.ts_c IS NOT NULL) AS prev_cart_rn,
        (SELECT min(b.ts_p) FROM @us1 b WHERE b.user_pseudo_id=a.user_pseudo_id AND b.rn>a.rn) AS next_purchase_ts,
        (SELECT max(t0) FROM @us1) AS window_end_ts FROM @us1 a""",
    # with a cart in the session there is nothing to look back at
    "pp": f"""SELECT CASE WHEN s5 THEN '{PATHS[0]}' ELSE '{PATHS[1]}' END AS path, coalesce(revenue,0.0) AS revenue, rn AS session_number_in_window,
        CAST(NULL AS DOUBLE) AS hours_since_cart, CAST(NULL AS BIGINT) AS sessions_since_cart FROM @us WHERE ts_p IS NOT NULL AND ts_c IS NOT NULL
        UNION ALL SELECT CASE WHEN prev_cart_rn IS NULL THEN '{PATHS[3]}' ELSE '{PATHS[2]}' END, coalesce(revenue,0.0), rn,
        (ts_p-prev_cart_ts)/CAST(3600000000 AS DOUBLE), rn-prev_cart_rn FROM @us WHERE ts_p IS NOT NULL AND ts_c IS NULL""",
    "cr": """SELECT ts_k IS NOT NULL AS reached_checkout, (next_purchase_ts-ts_c)/CAST(3600000000 AS DOUBLE) AS hours_to_next_purchase,
        (window_end_ts-ts_c)/CAST(3600000000 AS DOUBLE) AS hours_left FROM @us WHERE ts_c IS NOT NULL AND ts_p IS NULL""",
    # export
    "fct0": "SELECT *, coalesce(session_medium,'(not set)') AS channel FROM @ss WHERE s1",
    "fsm": "SELECT channel, count(*)/sum(count(*)) OVER ()<0.01 AS small FROM @fct0 GROUP BY 1",
    "fct": f"""SELECT user_pseudo_id||'-'||CAST(session_id AS VARCHAR) AS session_key, user_pseudo_id, session_date, device_category, channel,
        CASE WHEN small AND (SELECT count(*) FILTER (WHERE small) FROM @fsm)>1 THEN 'other ('||(SELECT count(*) FILTER (WHERE small) FROM @fsm)||' small channels)'
        ELSE channel END AS channel_group, coalesce(first_touch_medium,'(not set)') AS first_touch_medium, coalesce(country,'(not set)') AS country,
        {VISITOR} AS visitor_type, coalesce(landing_page,'(no page_view)') AS landing_page, n_medium=0 AS unattributed, n_events,
        s2 AS saw_product, s3 AS added_to_cart, s4 AS began_checkout, s5 AS purchased, ts_p IS NOT NULL AS purchased_any_order,
        CASE WHEN s5 THEN coalesce(revenue,0.0) ELSE 0.0 END AS revenue, CASE WHEN s5 THEN (ts_p-ts_s)/CAST(6e7 AS DOUBLE) END AS minutes_to_purchase
        FROM @fct0 JOIN @fsm USING (channel)""",
    "tst0": """SELECT 'device × purchase' AS test, device_category AS segment, count(*) AS n, count(*) FILTER (WHERE purchased) AS k FROM @fct WHERE device_category IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'channel × saw a product (named channels)', channel_group, count(*), count(*) FILTER (WHERE saw_product) FROM @fct
          WHERE NOT (starts_with(channel_group,'other (') OR starts_with(channel_group,'(not set)')) GROUP BY 2
        UNION ALL SELECT 'new vs returning × purchase', visitor_type, count(*), count(*) FILTER (WHERE purchased) FROM @fct
          WHERE visitor_type IN ('new','returning') GROUP BY 2""",
}
CTE["sq"] = " UNION ALL ".join(cut(name) for name in CUTS)
_lo, _hi = wilson("purchase", "sessions")
CTE["nvr"] = f"""SELECT visitor, sessions, purchase, {RATES}, {_lo} AS ci_lo, {_hi} AS ci_hi,
    (SELECT max(purchase/sessions) FILTER (WHERE visitor='returning')/nullif(max(purchase/sessions) FILTER (WHERE visitor='new'),0) FROM @vis) AS cvr_ratio,
    t.chi2, t.p, t.cramers_v FROM @vis, ({chi2_cte('SELECT * FROM @vis','purchase','sessions')}) t"""
_lo, _hi = wilson("carting_sessions", "viewing_sessions")
CTE["rk"] = f"""SELECT item_category, viewing_sessions, carting_sessions, atc_pct, median_price, ci_lo, ci_hi, average_pct,
    CASE WHEN ci_hi<average_pct THEN 'below' WHEN ci_lo>average_pct THEN 'above' ELSE 'neutral' END AS status,
    CASE WHEN ci_hi<average_pct THEN CAST(round_even((average_pct-atc_pct)/100*viewing_sessions,0) AS BIGINT) ELSE 0 END AS carts_at_stake
    FROM (SELECT *, {_lo} AS ci_lo, {_hi} AS ci_hi FROM @li, @avg1 WHERE level='product type')"""
CTE["mx0"] = """SELECT g.cohort_week, g.k AS weeks_since_cohort, CASE WHEN g.cohort_week+CAST(g.k*7+6 AS INTEGER)<=DATE '2001-08-01'
    THEN coalesce(c.active_users,0) END AS active_users FROM (SELECT cohort_week, k FROM (SELECT DISTINCT cohort_week FROM @coh)
    CROSS JOIN (SELECT DISTINCT weeks_since_cohort AS k FROM @coh)) g
    LEFT JOIN @coh c ON c.cohort_week=g.cohort_week AND c.weeks_since_cohort=g.k"""
CTE["mx"] = f"""SELECT *, {pct('active_users','cohort_size')} AS retention_pct FROM (SELECT cohort_week, weeks_since_cohort,
    CAST(max(active_users) FILTER (WHERE weeks_since_cohort=0) OVER (PARTITION BY cohort_week) AS BIGINT) AS cohort_size, active_users FROM @mx0)"""


def _needed(sql: str, ordered: list[str]) -> None:
    """Named steps (written @name) the SQL uses, each after those it is built from."""
    for name in re.findall(r"@(\w+)", sql):
        if name not in ordered:
            _needed(CTE[name], ordered)
            ordered.append(name)


def statement(select: str, doubles: str = "") -> str:
    """The SELECT with the named steps it mentions; the given double columns are rounded."""
    ordered: list[str] = []
    _needed(select, ordered)
    head = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" if n in ("coh", "mx0") else f"{n} AS ({CTE[n]})" for n in ordered) + "\n" if ordered else ""
    if doubles:
        rounded = ", ".join(f"round(CAST({c} AS DOUBLE),6)+0 AS {c}" for c in doubles.split())
        select = f"SELECT * REPLACE ({rounded}) FROM ({select})"
    return (head + select).replace("@", "")
