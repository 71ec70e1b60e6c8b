"""Sessions of a stream against the batch table over the same files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionlens.operators.funnel import session_funnel
from sessionlens.operators.sessions import funnel_sessions, session_base
from sessionlens.sources.staging import scratch_path
from sessionlens.streaming.sessions import replay, stream_sessions, stream_steps
from tests.shop import event, flat

HOUR = 3600
GAP, LATENESS = dt.timedelta(hours=1), dt.timedelta(minutes=30)
# A stream's first watermark is the epoch, so events begin a day after it.
START, END = 24 * HOUR, dt.datetime(1970, 1, 4)


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def files(spark, batches):
    """A folder of event files, written one after the other."""
    path = scratch_path(spark, "arrivals")
    for batch in batches:
        flat(spark, batch).coalesce(1).write.mode("append").parquet(path)
    return path, flat(spark, batches[0]).schema


def visit(user, sid, at, *names, **more):
    return [event(name, user, sid, START + at + 60 * i, medium="cpc" if i else None, page=f"https://s/{sid}/{i}", **more) for i, name in enumerate(names)]


FULL = ("session_start", "page_view", "view_item", "add_to_cart", "begin_checkout", "purchase")


def arrivals():
    """Three files: in order, one with events up to half an hour older than the newest before, and one a session goes on in."""
    first = visit("a", 1, 0, *FULL) + visit("b", 2, HOUR, "session_start", "view_item") + visit(None, 3, HOUR, "session_start")
    second = visit("b", 2, HOUR + 300, "add_to_cart") + visit("c", 4, HOUR - 600, "view_item", "session_start")
    third = visit("c", 4, HOUR + 1200, "view_item", "add_to_cart") + visit("d", 5, 10 * HOUR, *FULL[2:])
    return [first, second, third]


@pytest.mark.parametrize("build", [stream_sessions, stream_steps])
def test_ended_sessions_equal_the_batch_table(spark, build):
    path, schema = files(spark, arrivals())
    run = replay(spark, path, schema, lambda ev: build(ev, GAP, LATENESS), END, files_per_batch=1)
    batch = session_base(spark.read.schema(schema).parquet(path))
    assert run.late == 0
    assert rows_of(run.table) == rows_of(batch.select(*run.table.columns))
    assert run.table.where("session_id = -1").count() == 0
    assert rows_of(session_funnel(run.table)) == rows_of(session_funnel(funnel_sessions(batch)))


@pytest.mark.parametrize("build", [stream_sessions, stream_steps])
def test_events_past_the_watermark_are_dropped_and_counted(spark, build):
    # Spark holds a batch's events against the watermark of the batch before.
    on_time = [visit("a", 1, 0, *FULL), visit("b", 2, 20 * HOUR, *FULL), visit("b", 2, 20 * HOUR + 600, "purchase")]
    path, schema = files(spark, [*on_time, visit("z", 9, 0, "session_start")])
    run = replay(spark, path, schema, lambda ev: build(ev, GAP, LATENESS), END, files_per_batch=1)
    assert run.late == 1 and {r[0] for r in run.table.select("session_id").collect()} == {1, 2}


def test_a_longer_pause_ends_a_session(spark):
    path, schema = files(spark, [visit("a", 1, 0, "session_start", "view_item"), visit("a", 1, 5 * HOUR, "purchase")])
    run = replay(spark, path, schema, lambda ev: stream_sessions(ev, GAP, LATENESS), END, files_per_batch=1)
    assert [r["n"] for r in run.table.orderBy("n_events").select(F.col("n_events").alias("n")).collect()] == [1, 2]


def test_sessions_without_an_id_and_an_empty_stream(spark):
    path, schema = files(spark, [[event("session_start", "a", None, START)]])
    run = replay(spark, path, schema, lambda ev: stream_steps(ev, GAP, LATENESS), END)
    assert run.table.count() == 0 and run.late == 0


@pytest.mark.parametrize("build", [stream_sessions, stream_steps])
def test_events_between_far_steps_keep_a_session_open(spark, build):
    opened = visit("a", 1, 0, "session_start") + visit("a", 1, 50 * 60, "scroll")
    others = [visit("b", 2, 95 * 60, "session_start"), visit("b", 2, 96 * 60, "view_item")]
    path, schema = files(spark, [opened, *others, visit("a", 1, 100 * 60, "purchase"), visit("c", 3, 100 * 60, "scroll")])
    run = replay(spark, path, schema, lambda ev: build(ev, GAP, LATENESS), END, files_per_batch=1)
    found = run.table.where("ts_s IS NOT NULL OR ts_p IS NOT NULL").select("user_pseudo_id", F.col("ts_p").isNotNull()).collect()
    assert sorted(map(tuple, found)) == [("a", True), ("b", False)] and run.late == 0


def test_steps_stay_out_of_python(spark):
    path, schema = files(spark, arrivals())
    ev = stream_steps(spark.readStream.schema(schema).parquet(path), GAP, LATENESS)
    assert "InPandas" not in ev._jdf.queryExecution().analyzed().toString()
