"""The shop's events from small tables of its own."""

import datetime as dt

import pytest

from sessionlens.sources.driver_tables import order_visits, shop_events
from sessionlens.sources.events import flatten_events


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    at = lambda hour: dt.datetime(2024, 1, 3, hour)
    rows = {
        "events": ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", [
            (1, at(8), 3, "view", 1.0, '{"k": 2}'), (3, at(9), 3, "click", 1.0, '{"k": 3}'), (5, at(9), 4, "click", 2.0, '{"k": 1}'),
            (7, at(10), 4, "view", 1.0, '{"k": 4}'), (9, at(11), 5, "view", 1.0, '{"k": 3}'), (11, at(9), 90, "view", 1.0, '{"k": 1}'),
        ]),
        "part": ("p_partkey long, p_name string, p_type string, p_size int", [(i, f"part {i}", "STANDARD" if i == 8 else "LARGE", i) for i in range(14) if i not in (0, 1, 2)]),
        "nation": ("n_nationkey int, n_name string", [(i, f"nation {i}") for i in range(25)]),
        "pages": ("page_id long, url string", [(0, "https://s/a")]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{root}/{name}.parquet")
    return root


def test_lists_show_a_users_parts_and_carting_carts_the_first(spark, tables):
    found = shop_events(spark, tables).where("items IS NOT NULL").selectExpr(
        "user_pseudo_id", "event_name", "items.item_name AS names", "items.quantity AS quantity", "device.category", "geo.country", "traffic_source.medium"
    ).collect()
    # 11 parts are left, so a user's first key is 7 * user_id % 11; keys 0 to 2 are not in the table
    assert sorted(map(tuple, found), key=repr) == [
        ("3", "add_to_cart", ["part 10"], [1], "desktop", "nation 3", "organic"),
        ("3", "view_item", ["part 10"], [None], "desktop", "nation 3", "organic"),
        ("4", "add_to_cart", ["part 6"], [1], "mobile", "nation 4", "cpc"),
        ("5", "view_item", ["part 3", "part 4"], [None, None], "tablet", "nation 5", "(none)"),
        ("90", "view_item", ["part 3"], [None], "desktop", "", "organic"),
    ]


def test_no_sort_by_user_and_hour_holds_the_lists(spark, tables):
    lines = shop_events(spark, tables)._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    start = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line and "bucket" in line)
    below = []
    for line in lines[start + 1 :]:
        if depth(line) <= depth(lines[start]):
            break
        below.append(line)
    assert below and not any("collect_list" in line for line in below)


def test_flat_events_look_nothing_up_in_parameters(spark, tables, tmp_path):
    at = dt.datetime(1996, 1, 2)
    spark.createDataFrame([(1, 7, at, "1-URGENT"), (2, None, None, None)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    visits = flatten_events(order_visits(spark, str(tmp_path)))
    for flat in (flatten_events(shop_events(spark, tables)), visits):
        plan = flat._jdf.queryExecution().optimizedPlan().toString()
        assert "array_position" not in plan and "ga_session_id" not in plan
    rows = visits.select("user_pseudo_id", "session_id", "session_number", "medium", "eng_msec", "page_path", "event_date").collect()
    assert sorted(map(tuple, rows), key=repr) == [("7", 1, None, "1-URGENT", None, None, "19960102"), (None, 2, None, None, None, None, None)]


def test_sessions_end_after_twelve_hours_wherever_their_buckets_end(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("gaps"))
    at = lambda hour, us=0: dt.datetime(2024, 1, 3) + dt.timedelta(hours=hour, microseconds=us)
    # user 1: 12 hours sharp keep a session, a microsecond more ends it; user 2: both sides of noon and midnight; user 3: two events at once
    times = [(1, at(1)), (1, at(13)), (1, at(25, 1)), (2, at(11.9)), (2, at(12.1)), (2, at(23.9)), (2, at(24)), (2, at(36.5)), (3, at(5)), (3, at(5))]
    rows = [(2 * i + 1, ts, user, "error", 1.0, '{"k": 0}') for i, (user, ts) in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{root}/events.parquet")
    for name in ("part", "nation", "pages"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    flat = flatten_events(shop_events(spark, root))
    got = flat.groupBy("user_pseudo_id", "session_number").agg({"*": "count", "session_id": "min"}).collect()
    starts = {(r["user_pseudo_id"], r["session_number"]): (r["count(1)"], r["min(session_id)"]) for r in got}
    second = lambda when: int((when - dt.datetime(1970, 1, 1)).total_seconds())
    assert starts == {
        ("1", 1): (4, second(at(1))), ("1", 2): (3, second(at(25))), ("2", 1): (6, second(at(11.9))), ("2", 2): (3, second(at(36.5))),
        ("3", 1): (4, second(at(5))),
    }
