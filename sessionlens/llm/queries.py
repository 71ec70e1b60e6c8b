"""The registered query of each corpus operator: the operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlens.llm import decontaminate, exact, fingerprint, html, language, lines, minhash, mixing, periods, pii, repair, suffix, toxicity
from sessionlens.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op1_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op3_pii(table(spark, sf_dir, "documents"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.op4_suffix(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op5_language(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op6_minhash(table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op7_lines(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op8_html(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9_mixing(table(spark, sf_dir, "documents"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op10_fingerprint(table(spark, sf_dir, "documents"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.op11_exact(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op12_repair(table(spark, sf_dir, "conversations"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.op13_periods(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_suffix": op4_suffix,
    "op5_language": op5_language,
    "op6_minhash": op6_minhash,
    "op7_lines": op7_lines,
    "op8_html": op8_html,
    "op9_mixing": op9_mixing,
    "op10_fingerprint": op10_fingerprint,
    "op11_exact": op11_exact,
    "op12_repair": op12_repair,
    "op13_periods": op13_periods,
}

#: SQL for those that DuckDB can express; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op9_mixing": mixing.oracle()}
