"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.llm.common import FILE_ROWS, LEAST_FILES, written


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the smallest node reachable.

    Each round gives a node, and the node that labels it, the least label of the labels around it, then the label's own label, so that
    chains and chains of stars shrink by a power. Tables are written between rounds, and partial minima keep nodes with many
    links spread. No step has more tasks than its links fill, since the driver keeps figures of each task. With `rounds`, labels after so many of them: two nodes with one label are connected, others may be.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = written(both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u != v").distinct(), "links")
    size = both.count()
    few = lambda df: df.coalesce(max(LEAST_FILES, size // FILE_ROWS))
    label = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("component"))
    label = written(label, "labels", size)
    done = 0
    while rounds is None or done < rounds:
        done += 1
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("next"))
        far = few(label.join(jump, "component").select("node", "component", "next"))
        around = few(both.join(far.select(F.col("node").alias("u"), F.col("component").alias("label"), F.col("next").alias("own")), "u"))
        around = few(around.join(far.select(F.col("node").alias("v"), F.col("next").alias("other")), "v").where("other < own"))
        told = around.select(F.explode(F.array("u", "label")).alias("node"), "other").groupBy("node").agg(F.min("other").alias("other"))
        after = far.join(told, "node", "left").select(
            "node", F.col("component").alias("was"), F.least("component", "next", "other").alias("component")
        )
        after = written(after, "labels", size)
        label = after.select("node", "component")
        if after.where("was != component").isEmpty():
            break
    return label
