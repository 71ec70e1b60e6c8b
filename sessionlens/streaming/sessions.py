"""Sessions of a stream of flat events: rows appear once the watermark says that a session has ended.

A session ends when its key (user, session id) has been quiet for `gap`; events may come out of order by up to `lateness`.
Events later than that are dropped by the watermark and counted in the run's `late`. A key that goes on after a longer pause gets a
second row, as in `operators.session_state`. Sessions without an id are left out, as in the batch table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sessionlens.model import MICROS_PER_SECOND, STEP_TS, STEPS
from sessionlens.operators.sessions import SESSION, session_aggs, with_step_flags
from sessionlens.sources.staging import scratch_path

EVENT_TIME = "event_time"
STEP_COLUMNS = tuple(STEP_TS[step] for step in STEPS)
#: Session id of the row that ends a stream; its own session never ends, so it never shows.
END = -1


def _timed(ev: DataFrame, lateness: dt.timedelta) -> DataFrame:
    rows = ev.where(F.col("session_id").isNotNull())
    return rows.withColumn(EVENT_TIME, F.timestamp_micros("event_timestamp")).withWatermark(EVENT_TIME, _interval(lateness))


def _interval(span: dt.timedelta) -> str:
    return f"{int(span.total_seconds())} seconds"


def stream_sessions(
    ev: DataFrame, gap: dt.timedelta, lateness: dt.timedelta, dims: dict[str, Column] | None = None
) -> DataFrame:
    """`session_base` of a stream: the same aggregates by key and session window, with a partial one before the shuffle."""
    window = F.session_window(EVENT_TIME, _interval(gap))
    ended = _timed(ev, lateness).groupBy(window, *SESSION).agg(*session_aggs(dims)).drop("session_window")
    return with_step_flags(ended)


def stream_steps(ev: DataFrame, gap: dt.timedelta, lateness: dt.timedelta) -> DataFrame:
    """First time of each funnel step and the flags of a session, given out once the session has ended.

    The state of a session is its window and five first times, whatever it holds; every event of a session keeps it open, as in
    `stream_sessions`, and sessions without a step do not show. Steps are not given out as they come: an earlier event that comes
    late can still undo one. The aggregates run in generated code: a Python call a session cost about a millisecond each.
    """
    window = F.session_window(EVENT_TIME, _interval(gap))
    first = [F.min(F.when(F.col("event_name") == step, F.col("event_timestamp"))).alias(STEP_TS[step]) for step in STEPS]
    ended = _timed(ev, lateness).groupBy(window, *SESSION).agg(*first).drop("session_window")
    return with_step_flags(ended.where(F.coalesce(*STEP_COLUMNS).isNotNull()))


@dataclass(frozen=True)
class Run:
    """What a replay has written, and how many rows (combined ones where a partial aggregate comes first) were late."""

    table: DataFrame
    late: int


def replay(
    spark: SparkSession,
    path: str,
    schema: StructType,
    build: Callable[[DataFrame], DataFrame],
    upto: dt.datetime,
    files_per_batch: int | None = None,
) -> Run:
    """Run `build` over the event files of a folder as a stream until all are read, then end every session.

    `upto` (UTC) lies past the last event by more than gap and lateness together. It comes in as a last row in a second run from
    the same checkpoint, when all files have been read, and moves the watermark there. Files come in order of writing. State,
    offsets and results lie in the shared folder, so a lost executor costs the batch at hand.
    """
    root = scratch_path(spark, "stream")
    ends, out, state = f"{root}/ends", f"{root}/out", f"{root}/state"
    spark.createDataFrame([], schema).write.parquet(ends)

    def source(folder: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(folder).select(*schema.names)

    def run() -> int:
        stream = build(source(path).unionByName(source(ends)))
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
            .trigger(availableNow=True).start(out)
        )
        query.awaitTermination()
        dropped = (op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
        return sum(dropped)

    late = run()
    moment = int(upto.replace(tzinfo=dt.timezone.utc).timestamp()) * MICROS_PER_SECOND
    fixed = {"event_timestamp": F.lit(moment), "event_name": F.lit(STEPS[0]), "session_id": F.lit(END)}
    last = [fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*last).write.mode("append").parquet(ends)
    late += run()
    return Run(spark.read.parquet(out), late)
