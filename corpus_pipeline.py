"""Training-data pipeline over `documents`: toxic documents, repeated lines, near-duplicates and benchmark leaks go, and the rest is
mixed to target weights. Each stage's rows are written and read again as the next stage's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionlens.llm import decontaminate, lines, minhash, mixing, toxicity
from sessionlens.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic spans, by a tagger learned from the labelled ones among them."""
    tagger = toxicity.learn(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, tagger)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that stand before; one that has nothing else goes."""
    out = lines.dedup_lines(docs, counts=("__units", "__removed")).where((F.col("__removed") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates. Rows that share an id are one document: they stay or go
    together; rows without an id stay."""
    others = minhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item. Rows are told apart by id and text, so those without an id, or with one that others have, are
    judged by their own text."""
    key = F.xxhash64("doc_id", "text")
    found = decontaminate.leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(found.select(F.col("doc_id").alias("__leak")).distinct(), key == F.col("__leak"), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the targets of sources, languages and topics."""
    return mixing.mix(docs).where("sampled").drop("sampled")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: The tagger and the near-duplicate groups are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
