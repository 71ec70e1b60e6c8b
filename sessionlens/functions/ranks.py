"""Exact order statistics that never gather a whole group in one task.

Spark's `percentile` keeps one map entry per distinct value of a group in a single buffer, and a
window over a group sorts it in a single task; both fail on a group of billions of distinct values.
Here a monotone bin of the value is counted first (a small table per group), the bin holding the wanted
rank is located by running counts, and only that bin's values are ranked; a bin that is still large is
divided again. The result is exact: binning decides only which rows are looked at, counting decides the answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionlens.functions.exprs import null_safe_key

BINS_PER_OCTAVE = 1024
#: Parts of a bin that is divided, and rows of different values above which it is.
PARTS = 1024
LARGEST = 1_000_000
#: Writes a small table and reads it back; None does without.
Materialise = Callable[[DataFrame], DataFrame] | None
#: What a located bin says about its group: values, wanted ranks, position, values below the bin.
RANKS = ("_total", "_lo", "_hi", "_di", "_pos", "_before")


def value_bin(value) -> Column:
    """Monotone whole-number bin: about 0.07% relative width for |value| well above 1."""
    v = F.col(value) if isinstance(value, str) else value
    octaves = F.least(F.log2(1 + F.abs(v)), F.lit(1100.0))  # above any finite double
    return (F.signum(v) * F.floor(octaves * BINS_PER_OCTAVE)).cast("long")


def _is_number(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def _wanted(counted: DataFrame, group: list[str], bin_column: str, before: Column) -> DataFrame:
    """The bins that hold a wanted rank, with the number of values below each as `_before`."""
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(bin_column).rowsBetween(Window.unboundedPreceding, 0))
    return (
        counted.withColumn("_upto", before + upto)
        .where(
            (F.col("_upto") >= F.least("_lo", "_di"))
            & (F.col("_upto") - F.col("_n") < F.greatest("_hi", "_di"))
        )
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .drop("_upto")
    )


def _part(v: Column) -> Column:
    """Which of `PARTS` equal widths between the bin's least and greatest value holds a value; monotone like the bin itself."""
    low, high = F.col("_least"), F.col("_greatest")
    return F.when(high > low, F.floor((v - low) / (high - low) * PARTS)).otherwise(0).cast("long")


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    q: float = 0.5,
    few_groups: bool = False,
    materialise: Materialise = None,
    weight: str | None = None,
    largest: int = LARGEST,
) -> DataFrame:
    """Per group of `by`: n, q_cont (interpolated) and q_disc (first value reaching q); nulls and NaN ignored.

    `weight` names a column with the number of times a row counts (rows counted beforehand).

    The located bins are a few rows per group. How the values meet them depends on the groups:

    - `few_groups`: the grouping columns come from a fixed set of labels, so the bins are broadcast.
    - `materialise`: a function that writes a table and reads it back. The written bins have a known size, so
      Spark broadcasts them while they are small and shuffles when they are not. A located bin of more than
      `largest` rows with different values is divided again, as often as it takes: no task ranks more, however
      close together the values of a group are. Goes before `few_groups`.
    - neither: distinct values are counted first and matched to their bins by a shuffle join; right
      where values repeat, as prices do.

    In the first two, values outside the located bins are dropped before anything is shuffled.
    """
    two_reads = few_groups or materialise is not None
    keys = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    group_cols = [null_safe_key(F.col(c).cast("string")).alias(k) for c, k in zip(by, keys)] or [
        F.lit("").alias("_g0")
    ]
    values = df.where(_is_number(value)).select(
        *by, *group_cols, F.col(value).cast("double").alias("_v"),
        (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"),
    ).withColumn("_bin", value_bin("_v"))
    if not two_reads:
        values = values.groupBy(*by, *keys, "_bin", "_v").agg(F.sum("_w").alias("_w"))
    measures = [F.sum("_w").alias("_n")]
    if materialise is not None:
        measures += [F.count("*").alias("_rows"), F.min("_v").alias("_least"), F.max("_v").alias("_greatest")]
    counted = values.groupBy(*keys, "_bin").agg(*measures)

    position = (F.col("_total") - 1) * F.lit(float(q))
    ranked = (
        counted.withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
        .withColumn("_lo", F.floor(position) + 1)
        .withColumn("_hi", F.ceil(position) + 1)
        .withColumn("_di", F.greatest(F.ceil(F.col("_total") * F.lit(float(q))), F.lit(1)))
        .withColumn("_pos", position)
    )
    located = _wanted(ranked, keys, "_bin", F.lit(0)).drop("_n")
    if materialise is not None:
        values, located = _divided(values, materialise(located), [*keys, "_bin"], materialise, largest)
    elif few_groups:
        located = F.broadcast(located)
    # a bin keeps its name while it is divided, and its parts are numbered in further columns
    place = [*keys, *[c for c in located.columns if c.startswith("_bin")]]
    candidates = values.join(located, place)
    if two_reads:
        carried = [F.first(c).alias(c) for c in RANKS]
        candidates = candidates.groupBy(*by, *place, "_v").agg(F.sum("_w").alias("_w"), *carried)
    in_bin = Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = candidates.withColumn("_cum", F.col("_before") + F.sum("_w").over(in_bin))
    at = lambda rank: F.min(F.when(F.col("_cum") >= F.col(rank), F.col("_v")))
    return (
        reached.groupBy(*by, *keys)
        .agg(
            F.first("_total").alias("n"), F.first("_pos").alias("_pos"),
            at("_lo").alias("_vlo"), at("_hi").alias("_vhi"), at("_di").alias("q_disc"),
        )
        .select(
            *by, "n",
            (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * (F.col("_pos") - F.floor("_pos"))).alias("q_cont"),
            "q_disc",
        )
    )


def _divided(
    values: DataFrame, located: DataFrame, place: list[str], materialise: Callable[[DataFrame], DataFrame], largest: int
) -> tuple[DataFrame, DataFrame]:
    """Divide located bins into parts, and these again, until none holds over `largest` rows of different values.

    Each round looks only at the rows of the bins located before and keeps the parts that hold a wanted rank. One
    number comes to the driver a round. Parts get narrower `PARTS` times a round, so doubles are apart after six.
    """
    large = F.when(F.col("_greatest") > F.col("_least"), F.col("_rows"))
    while (located.agg(F.max(large)).first()[0] or 0) > largest:
        part = f"_bin{len(place)}"
        ranges = located.select(*place, "_least", "_greatest")
        values = values.join(ranges, place).withColumn(part, _part(F.col("_v"))).drop("_least", "_greatest")
        counted = values.groupBy(*place, part).agg(
            F.sum("_w").alias("_n"), F.count("*").alias("_rows"), F.min("_v").alias("_least"), F.max("_v").alias("_greatest"),
        )
        ranked = counted.join(located.select(*place, *RANKS), place)
        located = materialise(_wanted(ranked, place, part, F.col("_before")).drop("_n"))
        place = [*place, part]
    return values, located


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Distinct values of a column with their average rank over the whole column (ties share it)."""
    distinct = (
        df.where(_is_number(value))
        .groupBy(F.col(value).cast("double").alias(value))
        .agg(F.count("*").alias("_c"))
        .withColumn("_bin", value_bin(value))
    )
    # One row per bin, so the running total over all bins stays small whatever the data size.
    bins = distinct.groupBy("_bin").agg(F.sum("_c").alias("_n")).withColumn("_all", F.lit(0))
    order = Window.partitionBy("_all").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("_bin", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    in_bin = Window.partitionBy("_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        distinct.join(bins, "_bin")
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(in_bin))
        .select(value, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))
    )
