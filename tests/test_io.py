import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sessionlens.model import EventWindow
from sessionlens.plans.export import export_star_schema
from sessionlens.plans.study import Study, Thresholds
from sessionlens.sources import sinks
from sessionlens.sources.events import date_range, event_files, read_events, require_budget, scan_estimate
from sessionlens.sources.footers import column_chunks, column_estimate
from sessionlens.sources.staging import shared_dir, stage
from sessionlens.sources.versions import VersionConflict, VersionedTable, read_published
from tests.shop import event, item, raw


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake") / "events")
    days = ["20201130", "20201201", "20201202", "20201205"]
    events = [event("session_start", sid=i, at=i, day=d, items=[item()]) for i, d in enumerate(days)]
    raw(spark, events).write.partitionBy("event_date_part").parquet(path)
    return path


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_window_prunes_partitions(spark, lake):
    df = read_events(spark, lake, EventWindow("20201201", "20201203"))
    assert sorted(r["event_date"] for r in df.collect()) == ["20201201", "20201202"]
    text = plan_of(df.select("event_name"))
    assert "PartitionFilters: [isnotnull(event_date_part" in text and "ReadSchema: struct<event_name:string>" in text


def test_param_reads_only_the_needed_nested_fields(spark, lake):
    from sessionlens.functions.exprs import param

    text = plan_of(read_events(spark, lake).select(param("ga_session_id").alias("s")))
    assert "int_value" in text and "string_value" not in text.split("ReadSchema")[1]


def test_file_listing_queries(spark, lake):
    r = date_range(event_files(spark, lake)).first()
    assert tuple(r) == ("20201130", "20201205", 4)
    all_bytes = scan_estimate(event_files(spark, lake)).first()
    week = scan_estimate(event_files(spark, lake, EventWindow("20201201", "20201201"))).first()
    assert week["files"] == 1 and 0 < week["bytes"] < all_bytes["bytes"] and week["within_budget"]
    assert require_budget(event_files(spark, lake)) == all_bytes["bytes"]
    with pytest.raises(RuntimeError, match="scan refused"):
        require_budget(event_files(spark, lake), 10)


def test_columns_cost_what_their_footers_say(spark, lake, tmp_path):
    import glob

    import pyarrow.parquet as pq

    chunks = column_chunks(event_files(spark, lake)).cache()
    want = {}
    for path in glob.glob(f"{lake}/*/*.parquet"):
        footer = pq.read_metadata(path)
        for g in range(footer.num_row_groups):
            for c in range(footer.row_group(g).num_columns):
                chunk = footer.row_group(g).column(c)
                top = chunk.path_in_schema.split(".")[0]
                want[top] = want.get(top, 0) + chunk.total_compressed_size
    assert {r["column"]: r["bytes"] for r in column_estimate(chunks).collect()} == want
    some = column_estimate(chunks, ["event_name", "items"], budget=want["items"]).collect()
    assert [(r["column"], r["bytes"], r["rows"], r["within_budget"]) for r in some] == [
        ("event_name", want["event_name"], 4, False), ("items", want["items"], 4, False)
    ]
    assert require_budget(event_files(spark, lake), columns=["items"]) == want["items"]


def test_row_groups_beyond_the_filter_are_not_counted(spark, lake, tmp_path):
    path = str(tmp_path / "sorted")
    names = [event(name, sid=i, at=i, day="20201201") for i, name in enumerate(["add_to_cart", "purchase", "view_item"])]
    raw(spark, names).repartitionByRange(3, "event_name").write.partitionBy("event_date_part").parquet(path)
    chunks = column_chunks(event_files(spark, path))
    only = column_estimate(chunks, ["user_pseudo_id"], {"event_name": ["purchase", "scroll"]})
    assert [(r["column"], r["rows"], r["row_groups"]) for r in only.collect()] == [("event_name", 1, 1), ("user_pseudo_id", 1, 1)]


def test_files_without_a_footer_count_whole(spark, tmp_path):
    folder = tmp_path / "odd" / "event_date_part=2020-12-01"
    folder.mkdir(parents=True)
    (folder / "broken.parquet").write_bytes(b"x" * 1234)
    out = column_estimate(column_chunks(event_files(spark, str(tmp_path / "odd"))), ["items"], budget=1000).first()
    assert (out["column"], out["bytes"], out["within_budget"]) == (None, 1234, False)


def test_reading_refuses_beyond_the_budget(spark, lake):
    need = require_budget(event_files(spark, lake), columns=["event_name"])
    assert read_events(spark, lake, columns=["event_name"], budget=need).count() == 4
    with pytest.raises(RuntimeError, match="scan refused"):
        read_events(spark, lake, columns=["event_name"], budget=need - 1)
    with pytest.raises(RuntimeError, match="scan refused"):
        read_events(spark, lake, budget=10)


def test_publish_only_on_a_real_change(spark, frame, tmp_path):
    path = str(tmp_path / "published")
    at = lambda df, stamp: df.withColumn("generated_at", F.lit(stamp))
    one = frame("metric string, value long", [("a", 1), ("a", 1), ("b", 2)])
    assert sinks.publish_if_changed(at(one, "2024-01-01"), path)
    assert not sinks.publish_if_changed(at(one, "2024-01-02"), path)  # only the stamp
    assert read_published(spark, path).select("generated_at").distinct().first()[0] == "2024-01-01"
    fewer_copies = frame("metric string, value long", [("a", 1), ("b", 2)])
    assert sinks.publish_if_changed(at(fewer_copies, "2024-01-03"), path)
    assert sinks.publish_if_changed(at(frame("metric string, value long", [("a", 1), ("b", 3)]), "x"), path)
    assert sinks.publish_if_changed(frame("metric string, v long", [("a", 1)]), path)  # other columns


def test_a_failed_publication_leaves_the_old_version(spark, frame, tmp_path):
    path = str(tmp_path / "published")
    good = frame("metric string, value long", [("a", 1), ("b", 2)])
    assert sinks.publish_if_changed(good, path)
    broken = good.withColumn("value", F.when(F.col("metric") == "b", F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("value") + 1))
    with pytest.raises(Exception, match="lost"):
        sinks.publish_if_changed(broken, path)
    assert sorted(map(tuple, read_published(spark, path).collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(FileNotFoundError):
        read_published(spark, str(tmp_path / "never"))


def test_versions_are_whole_and_in_order(spark, frame, tmp_path):
    import os

    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *values: frame("n long", [(v,) for v in values])
    schema = rows(1).schema
    assert table.read() is None and table.versions() == []
    assert table.commit({"x": table.write(rows(1)), "y": table.write(rows(2))}, schema) == 1
    held = table.read()  # a reader of the first version
    late = table.write(rows(9))
    assert table.commit({"y": table.write(rows(3, 4))}, schema) == 2
    with pytest.raises(VersionConflict):
        table.commit({"x": late}, schema, after=1)
    numbers = lambda df: sorted(r["n"] for r in df.collect())
    assert numbers(held) == [1, 2] and numbers(table.read()) == [1, 3, 4] and numbers(table.read(parts=["y"])) == [3, 4]
    table.commit({"x": None}, schema)
    assert table.versions() == [2, 3] and numbers(table.read()) == [3, 4] and table.read(parts=["x"]) is None
    table.drop(late)
    kept = {f for v in table.versions() for f in table.manifest(v)["parts"].values()}
    assert {f"data/{f}" for f in os.listdir(f"{table.path}/data")} == kept


def test_staged_table_uses_the_configured_folder(spark, frame):
    df, path = stage(frame("d date, n long", [(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)]), "t", "d", "n")
    assert path.startswith(shared_dir(spark))
    assert df.dtypes == [("d", "date"), ("n", "bigint")] or sorted(df.columns) == ["d", "n"]
    assert sorted(r["n"] for r in df.collect()) == [1, 2]


class _Session:
    """Just the parts of a session that choosing the folder looks at."""

    def __init__(self, master, configured=None):
        context = {"master": master, "applicationId": f"app-{master}", "getCheckpointDir": lambda _: None}
        self.sparkContext = type("Context", (), context)()
        self.conf = type("Conf", (), {"get": lambda _, key, default: configured or default})()


def test_folder_choice():
    assert shared_dir(_Session("spark://x", "hdfs:///shared/")) == "hdfs:///shared"
    local = shared_dir(_Session("local[2]"))
    assert local == shared_dir(_Session("local[2]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://x"))


@pytest.fixture(scope="module")
def study(spark):
    from sessionlens.sources.driver_tables import shop_events

    small = Thresholds(landing_sessions=3, busy_week=2, inside_sessions=3, gap_share=0.8, gap_weeks=2, category_views=5, low_n=1)
    return Study(shop_events(spark, "/root/testdata/sf0.001"), EventWindow("20240101", "20240130"), small)


def test_star_export(spark, study, tmp_path):
    out = str(tmp_path / "star")
    counts = {r["table_name"]: r["rows"] for r in export_star_schema(study, out).collect()}
    assert set(counts) == set(study.star_tables()) and counts["fct_sessions"] == study.funnel.first()["sessions"]
    info = json.loads(spark.read.text(f"{out}/run_info").first()[0])
    assert info["window_start"] == "20240101" and info["rows"]["fct_sessions"] == counts["fct_sessions"]
    keys = spark.read.parquet(f"{out}/fct_sessions").select("session_key")
    assert keys.distinct().count() == keys.count()


def test_star_export_as_csv(spark, study, tmp_path):
    tables = {"dim_price_band": study.star_tables()["dim_price_band"]}
    rows = sinks.write_star_schema(spark, tables, str(tmp_path / "csv"), "csv").first()
    assert rows["rows"] == 5


def test_export_writes_nothing_when_tables_disagree(spark, study, tmp_path):
    import os

    broken = Study(study.raw, study.window, study.thresholds)
    broken.__dict__.update({k: v for k, v in study.__dict__.items() if k.startswith("_") or k in ("base", "sessions")})
    broken.__dict__["funnel"] = study.funnel.withColumn("purchase", F.col("purchase") + 1)
    out = str(tmp_path / "none")
    with pytest.raises(RuntimeError, match="do not reconcile"):
        export_star_schema(broken, out)
    assert not os.path.exists(out)


def test_findings_carry_every_report(study):
    tables = study.report_tables()
    rows = sinks.findings(tables)
    assert {r["section"] for r in rows.select("section").distinct().collect()} >= {"session_funnel", "channels", "priority"}
    views = rows.where("section = 'session_funnel' AND item = 'View Products' AND metric = 'sessions'").first()["number"]
    assert views == study.funnel.first()["view_item"]
    payload = sinks.findings_json({"funnel": study.funnel}).first()
    assert json.loads(payload["json"])["sessions"] == study.funnel.first()["sessions"]


def test_unstaged_study_gives_the_same_funnel(study):
    lazy = Study(study.raw, study.window, study.thresholds, staged=False)
    assert lazy.funnel.collect() == study.funnel.collect()


def test_a_study_keeps_to_its_window_and_compares_periods(spark):
    visit = lambda sid, day, *names: [event(n, user=f"u{sid}", sid=sid, at=sid, day=day) for n in names]
    events = visit(1, "20201115", "session_start") + visit(2, "20201205", "session_start", "view_item") + visit(3, "20201206", "session_start")
    events += visit(4, "20210105", "session_start", "view_item") + visit(5, "20210301", "session_start")
    window, november = EventWindow("20201201", "20210131"), EventWindow("20201101", "20201130")
    study = Study(raw(spark, events), window, staged=False, previous=november)
    assert study.funnel.first()["sessions"] == 3
    rows = {r["period"]: (r["sessions"], r["view_item"]) for r in study.periods.collect()}
    assert rows == {"current": (1, 1), "previous": (1, 0)}  # the window's last month against November
    assert study.compared_periods().first()["change_pp"] == 100.0
    assert Study(raw(spark, events), window, staged=False).periods is None
    with pytest.raises(ValueError, match="shares days"):
        Study(raw(spark, events), window, previous=EventWindow("20210101", "20210102"))
