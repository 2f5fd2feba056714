"""Nested run reports (JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from herdlens.sources.layout import FOLDERS, placed

# Animal and image numbers are keys, so they are declared as maps: inference would make each a field.
REPORT_SCHEMA = """
    pid string, load_model_start string, load_model_final string,
    animals map<string, struct<
        first_image_capture_time: string, last_image_capture_time: string, weight_prediction_final: string,
        total_of_images: bigint, suitable_images: bigint,
        imgs: map<string, struct<weight_prediction_start: string, weight_prediction_final: string>>>>
"""


def read_reports(spark: SparkSession, path: str, lines: bool = False, files: str = "metrics.json") -> DataFrame:
    """One indented document per run folder under ``path``, or with ``lines`` one per line as ``write_reports`` leaves them.

    A run that was too long for one document has several, with the ``part`` that each is; other documents have none.
    The layout has to be named: reading lines as one document keeps the first line only. A file with
    one indented document cannot be split over tasks; lines can.
    """
    reader = spark.read if lines else placed(spark.read, FOLDERS, files)
    return reader.schema(f"{REPORT_SCHEMA.strip()}, part int").option("multiLine", not lines).json(path)
