"""Event scans: window-pruned reads, the flat event table, file-listing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlens.functions.exprs import page_path, param
from sessionlens.model import EVENT_SCHEMA, EventWindow
from sessionlens.sources.budget import BUDGET
from sessionlens.sources.footers import column_chunks, column_estimate

PARTITION = "event_date_part"


def in_window(df: DataFrame, window: EventWindow) -> DataFrame:
    """Rows of the window's export days; on a partitioned table only those partitions are read."""
    return df.where(F.col(PARTITION).between(F.lit(window.first_day), F.lit(window.last_day)))


def read_events(
    spark: SparkSession, path: str, window: EventWindow | None = None, columns: list[str] | None = None, budget: int | None = None
) -> DataFrame:
    """Day-partitioned nested events with the canonical schema (no schema inference), or some of their columns.

    With a budget, refuses before any data is read when the files' footers say that the columns hold more bytes.
    """
    if budget is not None:
        require_budget(event_files(spark, path, window), budget, columns)
    df = spark.read.schema(EVENT_SCHEMA).parquet(path)
    df = in_window(df, window) if window else df
    return df.select(*columns) if columns else df


def flatten_events(raw: DataFrame) -> DataFrame:
    """Nested event rows to flat ones: the five parameters, page path and dimensions as columns.

    The parameter lookups read the whole parameter array, so this is done once and written; every
    operator then reads only the flat columns it names.
    """
    return raw.select(
        PARTITION,
        "event_date",
        "event_timestamp",
        "event_name",
        "user_pseudo_id",
        param("ga_session_id").alias("session_id"),
        param("ga_session_number").alias("session_number"),
        param("medium", "string").alias("medium"),
        param("engagement_time_msec").alias("eng_msec"),
        page_path(param("page_location", "string")).alias("page_path"),
        F.col("device.category").alias("device_category"),
        F.col("geo.country").alias("country"),
        F.col("traffic_source.medium").alias("first_touch_medium"),
        F.col("ecommerce.purchase_revenue").alias("purchase_revenue"),
        "items",
    )


def event_files(spark: SparkSession, path: str, window: EventWindow | None = None) -> DataFrame:
    """One row per data file (path, length, day), from the file listing alone.

    The binary-file source opens no file as long as `content` is not selected, and the window prunes
    partition folders, so the cost follows the number of files, not of events.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length", F.to_date(F.col(PARTITION).cast("string")).alias(PARTITION))
    )
    return in_window(files, window) if window else files


def date_range(files: DataFrame) -> DataFrame:
    """Earliest and latest export day and the number of daily partitions, from `event_files`."""
    return files.groupBy(PARTITION).agg(F.count("*")).agg(
        F.date_format(F.min(PARTITION), "yyyyMMdd").alias("earliest_date"),
        F.date_format(F.max(PARTITION), "yyyyMMdd").alias("latest_date"),
        F.count(PARTITION).alias("num_daily_tables"),
    )


def scan_estimate(files: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Bytes and files a scan of the listed files could touch at most, against a budget."""
    total = F.coalesce(F.sum("length"), F.lit(0))
    return files.agg(
        total.alias("bytes"),
        F.count("*").alias("files"),
        F.lit(budget).cast("long").alias("budget_bytes"),
        (total <= budget).alias("within_budget"),
    )


def require_budget(files: DataFrame, budget: int = BUDGET, columns: list[str] | None = None) -> int:
    """Raise before any data is read when the listed files, or the named columns in them, exceed the budget; else their bytes."""
    if columns is None:
        size = scan_estimate(files, budget).first()["bytes"]
    else:
        size = column_estimate(column_chunks(files), columns, budget=budget).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    if size > budget:
        raise RuntimeError(
            f"scan refused: {size} bytes exceed the budget of {budget}; narrow the window or the columns, or raise the budget"
        )
    return size
