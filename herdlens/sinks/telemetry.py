"""CSV logs written per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.functions.clock import format_iso
from herdlens.sources.telemetry import CSV_OPTIONS


def _write(df: DataFrame, path: str, order: str) -> None:
    """One folder per run. Rebalancing gathers small runs and splits a large one over several files."""
    spread = df.hint("rebalance", "pid").sortWithinPartitions("pid", order)
    spread.write.partitionBy("pid").options(**CSV_OPTIONS, ignoreLeadingWhiteSpace=False).csv(path)


def write_telemetry(df: DataFrame, path: str) -> None:
    """CPU, memory or GPU rows (``pid, timestamp, ...``) with ISO timestamps."""
    _write(df.withColumn("timestamp", format_iso("timestamp")), path, "timestamp")


def format_power(readings: DataFrame, wide: bool = True) -> DataFrame:
    """Power rows as the meter log's fixed-width text fields."""
    # The log's number formats.
    formats = {"Time[S]": "%5.1f", "Volt[V]": "%07.4f", "Current[A]": "%07.5f", "Power[W]": "%07.4f"}
    if wide:
        formats |= {
            "Res[Ohm]": "%5.2f",
            "G0[mAh]": "%6d",
            "G0[mWh]": "%6d",
            "G1[mAh]": "%6d",
            "G1[mWh]": "%6d",
            "Temp[C]": "%+3d",
            "D+[V]": "%4.2f",
            "D-[V]": "%4.2f",
        }
    texts = [F.format_string(form, F.col(f"`{name}`")).alias(name) for name, form in formats.items()]
    return readings.select("pid", format_iso("timestamp").alias("Datetime"), *texts)


def write_power(readings: DataFrame, path: str, wide: bool = True) -> None:
    _write(format_power(readings, wide), path, "Datetime")


def format_recording(records: DataFrame) -> DataFrame:
    """Recording rows (``pid, Rec, Volt, Current``) as fixed-width text fields."""
    return records.select(
        "pid",
        F.format_string("%4d", "Rec").alias("Rec"),
        F.format_string("%07.4f", "Volt").alias("Volt[V]"),
        F.format_string("%07.5f", "Current").alias("Current[A]"),
    )


def write_recording(records: DataFrame, path: str) -> None:
    _write(format_recording(records), path, "Rec")
