"""Writing results: star schema, findings, publish-on-change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sessionlens.sources.versions import VersionedTable


def write_star_schema(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    path: str,
    fmt: str = "parquet",
    run_info: dict[str, str] | None = None,
    order: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """Write every table under `path`, then one run-info JSON row; returns (table, rows) counts.

    Counts come from the written files, not from a second run of the plans. `order` names the columns that
    each file of a table is sorted by, such as `operators.star.EXPORT_ORDER`.
    """
    for name, df in tables.items():
        df = df.sortWithinPartitions(*order[name]) if order and name in order else df
        writer = df.write.mode("overwrite")
        writer = writer.option("header", True) if fmt == "csv" else writer
        writer.format(fmt).save(f"{path}/{name}")
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    counts = reduce(
        DataFrame.unionByName,
        [
            reader.format(fmt).load(f"{path}/{name}").agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("table_name"), "rows"
            )
            for name in tables
        ],
    )
    info = counts.agg(F.map_from_entries(F.collect_list(F.struct("table_name", "rows"))).alias("rows"))
    for key, value in (run_info or {}).items():
        info = info.withColumn(key, F.lit(value))
    info = info.withColumn("generated", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm"))
    info.coalesce(1).write.mode("overwrite").json(f"{path}/run_info")
    return counts


def tidy(section: str, df: DataFrame) -> DataFrame:
    """Rows of a report table as (section, item, metric, number, text): text columns name the item, in the order of their names.

    A number or null stands in `number`; texts, days and truth values stand in `text`.
    """
    text = sorted(f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.DateType)))
    item = F.nullif(F.concat_ws(" · ", *[F.col(c).cast("string") for c in text]), F.lit("")) if text else F.lit(None).cast("string")
    pairs = []
    for f in df.schema:
        numeric = isinstance(f.dataType, T.NumericType)
        pairs.append(F.struct(
            F.lit(f.name).alias("metric"),
            (F.col(f.name).cast("double") if numeric else F.lit(None).cast("double")).alias("number"),
            (F.lit(None).cast("string") if numeric else F.col(f.name).cast("string")).alias("text"),
        ))
    return df.select(
        F.lit(section).alias("section"), F.coalesce(item, F.lit("all")).alias("item"), F.explode(F.array(*pairs)).alias("_m")
    ).select("section", "item", "_m.metric", "_m.number", "_m.text")


def findings(tables: dict[str, DataFrame]) -> DataFrame:
    """Every computed number and verdict of the report tables, one row each."""
    return reduce(DataFrame.unionByName, [tidy(name, df) for name, df in tables.items()])


def findings_json(tables: dict[str, DataFrame]) -> DataFrame:
    """The report tables as JSON, one object per report row (section, json)."""
    rows = [
        df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("json"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def changed_rows(new: DataFrame, old: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose number of copies differs between two versions, `ignore` columns left out.

    `copies` is new minus old. One shuffle; copies are counted before it, so repeated rows cost nothing.
    """
    columns = [c for c in new.columns if c not in ignore]
    both = new.select(*columns, F.lit(1).alias("_d")).unionByName(old.select(*columns, F.lit(-1).alias("_d")))
    return both.groupBy(*columns).agg(F.sum("_d").alias("copies")).where("copies != 0")


def publish_if_changed(
    new: DataFrame, path: str, ignore: tuple[str, ...] = ("generated_at",)
) -> bool:
    """Publish a new version under `path` only when more than its stamps changed; read it with `read_published`.

    The new version is written aside first: its plan runs once, and what is published is what was compared. Readers see the
    version before until the new one is whole, and go on seeing it if the write fails.
    """
    table = VersionedTable(new.sparkSession, path)
    before = table.manifest()
    folder = table.write(new)
    if before is not None:
        old = table.read(before["version"])
        kept = [c for c in new.columns if c not in ignore]
        written = new.sparkSession.read.schema(new.schema).parquet(f"{table.path}/{folder}")
        if [c for c in old.columns if c not in ignore] == kept and changed_rows(written, old, ignore).isEmpty():
            table.drop(folder)
            return False
    table.commit({"all": folder}, new.schema, after=before["version"] if before else 0)
    return True
