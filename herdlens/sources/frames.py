"""Frame tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FRAME_SCHEMA = "pid string, animal int, img int, ts timestamp_ntz, elapsed double, h int, w int, pixels array<float>"


def read_frames(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Frames as parquet rows; only the columns a query names are read, so counters never touch pixels.

    ``elapsed`` is the capture side's: seconds since the passage began, read just before the frame was taken.
    """
    return spark.read.schema(FRAME_SCHEMA).parquet(path)


def list_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """Raw image files as ``path, modificationTime, length, content`` for the user's own decoder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def tune_for_frames(spark: SparkSession, pixels_per_frame: int, batch_bytes: int = 32 * 1024 * 1024) -> None:
    """Row batches of the parquet reader and of Arrow sized to hold about ``batch_bytes`` of pixels.

    The defaults suit narrow rows: thousands of full-size frames in one batch would need gigabytes.
    """
    rows = max(1, batch_bytes // (4 * pixels_per_frame))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(min(rows, 4096)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, 10000)))
