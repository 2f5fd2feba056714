"""Nested run reports written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame

from herdlens.operators.flatten import DOCUMENT_ROWS, nest_reports


def write_reports(
    rows: DataFrame,
    path: str,
    animals: DataFrame | None = None,
    animals_per_document: int | None = None,
    images_per_document: int | None = None,
    rows_per_document: int = DOCUMENT_ROWS,
) -> None:
    """Flat image rows, and animals without any, to report documents, one per run or part and line. See ``nest_reports``."""
    nest_reports(rows, animals, animals_per_document, images_per_document, rows_per_document).write.json(path)
