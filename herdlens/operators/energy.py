"""Energy from power readings: sum of power times the hours since the previous reading."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herdlens.functions.clock import HOUR_US, epoch_micros, hours, micros_between
from herdlens.functions.values import kilo, nan_to_null
from herdlens.operators.ordered import key_at, slices, starts_of_keys, with_previous

PARTS_SCHEMA = "pid string, energy_wh double, first_us bigint, first_power double, last_us bigint"


def power_intervals(readings: DataFrame, *tie: str) -> DataFrame:
    """Each reading with ``dt_us``, ``dt_hours`` and ``energy_wh`` since the previous one of its run.

    ``tie`` names columns that order readings of one instant; end with a unique one.
    """
    timed = readings.where(F.col("timestamp").isNotNull())
    lagged = with_previous(timed, ["pid"], ["timestamp", *tie], "timestamp", "__before")
    return (
        lagged.withColumn("dt_us", micros_between("__before", "timestamp"))
        .withColumn("dt_hours", hours("dt_us"))
        .withColumn("energy_wh", nan_to_null("Power[W]") * F.col("dt_hours"))
        .drop("__before")
    )


def _integrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run in this sorted slice: its inner energy and its first and last reading."""
    pid, energy, first_us, first_power, last_us = None, 0.0, None, None, None

    def row() -> pa.RecordBatch:
        values = [[pid[0]], [energy], [first_us], [first_power], [last_us]]
        types = [pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]
        names = ["pid", "energy_wh", "first_us", "first_power", "last_us"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        starts = starts_of_keys(batch, ["pid"], pid)
        us = batch.column("us").to_numpy(zero_copy_only=False)
        power = batch.column("power").to_numpy(zero_copy_only=False)  # a missing reading is NaN
        before = np.concatenate([[last_us if last_us is not None else us[0]], us[:-1]])
        inner = np.where(starts | np.isnan(power), 0.0, power * (us - before) / HOUR_US)
        bounds = np.flatnonzero(starts)
        edges = [0, *bounds[bounds > 0].tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:]):
            if starts[begin]:
                if pid is not None:
                    yield row()
                pid, energy = key_at(batch, ["pid"], begin), 0.0
                first_us = int(us[begin])
                first_power = None if np.isnan(power[begin]) else float(power[begin])
            energy += float(inner[begin:end].sum())
            last_us = int(us[end - 1])
    if pid is not None:
        yield row()


def energy_parts(readings: DataFrame) -> DataFrame:
    """Energy of time-disjoint pieces of each run, with the edges needed to join neighbouring pieces.

    Readings that share an instant add nothing beyond the first, so they fold into one (the smallest
    power) before any row moves; copies therefore cannot crowd a partition. The range partitioning
    then cuts long runs, and each task keeps one open piece only.
    """
    instants = (
        readings.where(F.col("timestamp").isNotNull())
        .groupBy(F.col("pid").cast("string").alias("pid"), epoch_micros("timestamp").alias("us"))
        .agg(F.min(nan_to_null(F.col("Power[W]").cast("double"))).alias("power"))
    )
    return slices(instants, ["pid"], ["us"]).mapInArrow(_integrate, PARTS_SCHEMA)


def join_parts(parts: DataFrame) -> DataFrame:
    """Pieces to one row per run: ``energy_wh`` and ``last_us``. A run has few pieces (one per task)."""
    previous_end = F.lag("last_us").over(Window.partitionBy("pid").orderBy("first_us", "last_us"))
    bridged = F.coalesce(F.col("first_power") * hours(F.col("first_us") - previous_end), F.lit(0.0))
    return (
        parts.withColumn("bridge_wh", bridged)
        .groupBy("pid")
        .agg(
            F.sum(F.col("energy_wh") + F.col("bridge_wh")).alias("energy_wh"),
            F.max("last_us").alias("last_us"),
        )
    )


def energy_by_run(readings: DataFrame) -> DataFrame:
    """``pid, energy_wh, energy_kwh``: 0 where a run has a single reading or no power values."""
    totals = join_parts(energy_parts(readings))
    return totals.select("pid", "energy_wh", kilo(F.col("energy_wh")).alias("energy_kwh"))
