"""Star-schema export: reconcile first, then write."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sessionlens.operators.star import EXPORT_ORDER, require_reconciled
from sessionlens.plans.study import Study
from sessionlens.sources.sinks import write_star_schema


def export_star_schema(study: Study, path: str, fmt: str = "parquet") -> DataFrame:
    """Write every export table under `path`; raises, writing nothing, if sessions and funnel differ."""
    require_reconciled(study.reconciliation())
    info = {"window_start": study.window.start, "window_end": study.window.end}
    return write_star_schema(study.spark, study.star_tables(), path, fmt, info, EXPORT_ORDER)
