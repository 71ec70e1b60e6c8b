"""What a scan would read, from Parquet footers: bytes by file, row group and column.

Footers are read on the executors, a task for some files, so the cost follows the number of files. A file whose file system the
footer reader does not know counts as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens.sources.budget import BUDGET

CHUNKS = "path string, event_date_part date, row_group int, column string, bytes long, rows long, low string, high string"


def column_chunks(files: DataFrame) -> DataFrame:
    """(path, event_date_part, row_group, column, bytes, rows, low, high) of the files listed by `event_files`.

    A nested column's bytes are those of all its leaves. `low` and `high` bound the texts of a column where the footer says so. A
    file that cannot be opened, or is no Parquet, is one row with a null row group and column and the file's length.
    """

    def footers(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        def opened(path: str):
            scheme, _, rest = path.partition(":")
            if scheme == "file":
                return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
            return pafs.FileSystem.from_uri(path)

        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = [pa.string(), pa.date32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for path, length, day in zip(*[batch.column(c).to_pylist() for c in ("path", "length", "event_date_part")]):
                rows = []
                try:
                    fs, where = opened(path)
                    footer = pq.read_metadata(where, filesystem=fs)
                except (OSError, ValueError, NotImplementedError):  # unknown file system, or no Parquet
                    rows.append((path, day, None, None, length, None, None, None))
                else:
                    for g in range(footer.num_row_groups):
                        group, by = footer.row_group(g), {}
                        for c in range(group.num_columns):
                            chunk = group.column(c)
                            top = chunk.path_in_schema.split(".")[0]
                            stats = chunk.statistics if top == chunk.path_in_schema else None
                            known = stats is not None and stats.has_min_max and isinstance(stats.min, str)
                            size, low, high = by.get(top, (0, None, None))
                            by[top] = (size + chunk.total_compressed_size, stats.min if known else low, stats.max if known else high)
                        rows += [(path, day, g, top, size, group.num_rows, low, high) for top, (size, low, high) in by.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

    return files.select("path", "length", "event_date_part").mapInArrow(footers, CHUNKS)


def _may_hold(values: list[str]) -> Column:
    """Whether a row group with these bounds can hold one of the values; unknown bounds can."""
    inside = [(F.lit(v) >= F.col("low")) & (F.lit(v) <= F.col("high")) for v in values]
    some = inside[0]
    for test in inside[1:]:
        some = some | test
    return F.coalesce(some, F.lit(True))


def column_estimate(
    chunks: DataFrame, columns: list[str] | None = None, only: Mapping[str, list[str]] | None = None, budget: int = BUDGET
) -> DataFrame:
    """(column, bytes, rows, row_groups, budget_bytes, within_budget) of a scan of the named columns, all by default.

    `only` gives the values that text columns are filtered by: row groups whose bounds exclude them all are not read, and the columns
    filtered by are read too. Files without a footer are a row with a null column and their whole length. `within_budget` is
    the same in all rows: whether all columns together stay within it.
    """
    only = dict(only or {})
    for column, values in only.items():
        out = chunks.where((F.col("column") == column) & ~_may_hold(values)).select("path", "row_group").distinct()
        chunks = chunks.join(out, ["path", "row_group"], "left_anti")
    if columns is not None:
        chunks = chunks.where(F.col("column").isin(*{*columns, *only}) | F.col("column").isNull())
    by = chunks.groupBy("column").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count("row_group").alias("row_groups"))
    total = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).scalar()
    return by.select("*", F.lit(budget).cast("long").alias("budget_bytes"), (total <= budget).alias("within_budget")).orderBy("column")
