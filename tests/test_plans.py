"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"

# Both sides are bounded: weak pages number at most 100 / min_share, located bins three per fixed group.
BOUNDED_BROADCASTS = {"landing_diagnosis", "revenue_summary", "time_to_convert", "purchase_path_summary", "category_summary"}



#: Queries of the main library that return a plan over the tables, rather than write files first.
PLANNED = [
    name for name in entry.queries()
    if name not in ("write_star_schema", "publish_if_changed", "session_days", "sketch_weeks", "stream_sessions", "stream_funnel", "findings", "findings_json") and not re.match(r"op\d+_|pipeline", name)
]


@pytest.fixture(scope="module")
def plan_of(spark):
    """The physical plan of a query by name, without size-based broadcasts."""
    known = {}

    def plan(name):
        if name not in known:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            try:
                known[name] = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            finally:
                spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        return known[name]

    return plan


@pytest.mark.parametrize("name", PLANNED)
def test_plan_scales(plan_of, name):
    """No nested loop, no Python, broadcasts of bounded tables only, and no window over all rows: every one has a key."""
    text = plan_of(name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in text
    assert "BroadcastExchange" not in text or name in BOUNDED_BROADCASTS
    for line in text.splitlines():
        if re.match(r"^[\s:+\-*()0-9]*Window \[", line):
            assert "SinglePartition" not in line and not line.rstrip().endswith("], []"), line[:200]


@pytest.mark.parametrize("name", ["session_funnel", "device_funnel", "landing_pages"])
def test_session_reports_read_the_written_table(plan_of, name):
    assert plan_of(name).count("FileScan") == 1 and "s1" in re.search(r"PushedFilters: \[[^\]]*\]", plan_of(name)).group(0)


def test_event_reports_push_their_filter(plan_of):
    assert "EqualTo(event_name,session_start)" in plan_of("unique_users")
    assert "ReadSchema: struct<event_name:string,user_pseudo_id:string>" in plan_of("unique_users")


def test_cohort_channel_reads_session_starts_and_the_session_table(plan_of):
    scans = [x for x in plan_of("cohort_channel").splitlines() if "FileScan" in x]
    starts = [x for x in scans if "EqualTo(event_name,session_start)" in x]
    assert len(scans) == 2 and len(starts) == 1 and plan_of("cohort_channel").count("Exchange hashpartitioning") <= 5
    assert "ReadSchema: struct<user_pseudo_id:string,session_id:bigint,session_medium:string>" in plan_of("cohort_channel")


def test_scan_prunes_days(plan_of):
    assert re.search(r"PartitionFilters: \[isnotnull\(event_date_part", plan_of("scan_events"))
