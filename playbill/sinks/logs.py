"""Append-only run log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from playbill.operators.runs import log_rows


def append_runs(runs: DataFrame, path: str) -> None:
    log_rows(runs).write.mode("append").parquet(path)
