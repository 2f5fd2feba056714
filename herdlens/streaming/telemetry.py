"""Utilisation of running machines in tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.functions.clock import event_time
from herdlens.functions.values import nan_to_null


def utilisation(rows: DataFrame, value: str, every: str, *keys: str) -> DataFrame:
    """``keys, window_start, readings, mean`` per tumbling window; the batch form."""
    return _windowed(rows, F.window("timestamp", every), value, *keys)


def utilisation_stream(rows: DataFrame, value: str, every: str, delay: str, *keys: str) -> DataFrame:
    """The same over a stream (append mode): a window is emitted once the watermark has passed its end."""
    timed = rows.withColumn("timestamp", event_time("timestamp")).withWatermark("timestamp", delay)
    return _windowed(timed, F.window("timestamp", every), value, *keys)


def _windowed(rows: DataFrame, window: Column, value: str, *keys: str) -> DataFrame:
    reading = nan_to_null(F.col(value).cast("double"))
    return (
        rows.groupBy(*keys, window.alias("w"))
        .agg(F.count(reading).alias("readings"), F.avg(reading).alias("mean"))
        .select(*keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "readings", "mean")
    )
