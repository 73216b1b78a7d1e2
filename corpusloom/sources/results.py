"""Writing analysis results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpusloom.operators.reports import export_rows


def write_results(results: DataFrame, path: str) -> None:
    """Per-file rows as JSON lines."""
    results.write.mode("overwrite").json(path)


def write_result_text(results: DataFrame, path: str) -> None:
    """Per-file rows reduced to name, path and requirements, one JSON text per line."""
    export_rows(results).write.mode("overwrite").text(path)
