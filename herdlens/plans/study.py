"""A study of recorded runs: everything the run folders under one path can tell, for all runs at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.functions.clock import epoch_micros
from herdlens.operators.distribution import density, histogram, line_series
from herdlens.operators.energy import energy_by_run, power_intervals
from herdlens.operators.flatten import (
    ANIMAL_TIMES,
    COUNTERS,
    IMAGE_TIMES,
    RUN_TIMES,
    compat_last_image,
    flatten_reports,
    with_durations,
)
from herdlens.operators.summary import describe, describe_long
from herdlens.plans import metrics
from herdlens.session import configure, shared_folder
from herdlens.sources import telemetry
from herdlens.sources.reports import read_reports

ANIMAL_MEASURES = ["lead_time_us", "processing_delay_us", "latency_us"]
RUN_MEASURES = ["collect_lead_time_us", "throughput_per_hour"]


class Study:
    """Run folders (``<run id>/metrics.json, cpu.csv, mem.csv, gpu.csv, power.csv``) as DataFrames.

    Every kind of file is parsed once, at its first use, and kept as a table in the shared folder; all figures come
    from those tables. Files that arrive later belong to a new study.

    ``image_weighted`` repeats an animal's figures for each of its images before they are summarised,
    and ``last_image`` lets the last image stand for all: both only to reproduce older numbers.
    """

    def __init__(self, spark: SparkSession, path: str, last_image: bool = False, image_weighted: bool = False):
        self.spark, self.path = configure(spark), path
        self.last_image, self.image_weighted = last_image, image_weighted
        self._tables: dict[str, DataFrame] = {}

    def _stored(self, name: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
        if name not in self._tables:
            rows, place = read(self.spark, self.path), shared_folder(self.spark, f"study-{name}")
            rows.write.parquet(place)
            self._tables[name] = self.spark.read.schema(rows.schema).parquet(place)
        return self._tables[name]

    def images(self) -> DataFrame:
        rows = self._stored("images", lambda spark, path: flatten_reports(read_reports(spark, path)))
        return compat_last_image(rows) if self.last_image else rows

    def animals(self) -> DataFrame:
        return metrics.animal_metrics(self.images())

    def runs(self) -> DataFrame:
        return metrics.run_metrics(self.animals())

    def compared(self, settings: DataFrame) -> DataFrame:
        """Runs beside ``settings`` (``pid, ..., baseline_pid``) with differences to the baseline."""
        return metrics.compare_runs(self.runs(), settings)

    def measures(self) -> DataFrame:
        """Summary statistics of the timing measures per run."""
        if self.image_weighted:
            rows, names = metrics.image_rows_with_metrics(self.images()), ANIMAL_MEASURES + RUN_MEASURES
        else:
            rows, names = self.animals(), ANIMAL_MEASURES
        return describe(rows, ["pid"], {n: F.col(n) for n in names})

    def report_summary(self) -> DataFrame:
        """Statistics of everything a report says: durations and times per image; counters, durations, times per animal."""
        images = with_durations(self.images())
        per_image = {n: F.col(n) for n in ("weight_prediction_dur_us", "load_model_dur_us")}
        image_times = {n: epoch_micros(n) for n in [*RUN_TIMES, *IMAGE_TIMES]}
        per_animal = {n: F.col(n) for n in [*ANIMAL_MEASURES, *COUNTERS]}
        animal_times = {n: epoch_micros(n) for n in [*ANIMAL_TIMES, "display_time"]}
        return describe(images, ["pid"], per_image | image_times, timestamps=list(image_times)).unionByName(
            describe(self.animals(), ["pid"], per_animal | animal_times, timestamps=list(animal_times))
        )

    def cpu(self) -> DataFrame:
        return self._stored("cpu", telemetry.read_cpu)

    def memory(self) -> DataFrame:
        return self._stored("memory", telemetry.read_memory)

    def gpu(self) -> DataFrame:
        return self._stored("gpu", telemetry.read_gpu)

    def power(self) -> DataFrame:
        return self._stored("power", telemetry.read_power)

    def energy(self) -> DataFrame:
        return energy_by_run(self.power())

    def cpu_summary(self) -> DataFrame:
        """Statistics of the time, of every core, whatever their number, and of the mean over cores."""
        values = F.concat(F.array(epoch_micros("timestamp").cast("double"), "cpu_mean"), "cores")
        long = self.cpu().select("pid", F.posexplode(values).alias("metric", "value")).where(F.col("value").isNotNull())
        core = F.concat(F.lit("cpu_core_"), (F.col("metric") - 2).cast("string"))
        name = F.when(F.col("metric") == 0, F.lit("timestamp")).when(F.col("metric") == 1, F.lit("cpu_mean")).otherwise(core)
        summary = describe_long(long, ["pid", "metric"])
        return summary.withColumn("std", F.when(F.col("metric") > 0, F.col("std"))).withColumn("metric", name)

    def memory_summary(self) -> DataFrame:
        measured = {n: F.col(n) for n in telemetry.MEMORY_FIELDS} | {"timestamp": epoch_micros("timestamp")}
        return describe(self.memory(), ["pid"], measured, timestamps=["timestamp"])

    def power_summary(self, *tie: str) -> DataFrame:
        """Statistics of all meter columns, the intervals and their energy."""
        columns = [c for c in telemetry.POWER_FIELDS if c != "Datetime"]
        measured = {c: F.col(f"`{c}`") for c in columns} | {c: F.col(c) for c in ("dt_hours", "energy_wh")}
        rows = power_intervals(self.power(), *(tie or ("Time[S]",)))
        return describe(rows, ["pid"], measured | {"timestamp": epoch_micros("timestamp")}, timestamps=["timestamp"])

    def cpu_series(self, every: str | None = None) -> DataFrame:
        return line_series(self.cpu(), ["pid"], "timestamp", "cpu_mean", every)

    def memory_series(self, every: str | None = None) -> DataFrame:
        return line_series(self.memory(), ["pid"], "timestamp", "percent", every)

    def power_series(self, every: str | None = None) -> DataFrame:
        return line_series(self.power(), ["pid"], "timestamp", "Power[W]", every)

    def cpu_histogram(self, bins: int = 20) -> DataFrame:
        return histogram(self.cpu(), ["pid"], "cpu_mean", bins)

    def memory_histogram(self, bins: int = 20) -> DataFrame:
        return histogram(self.memory(), ["pid"], "percent", bins)

    def cpu_density(self, grid: int = 200) -> DataFrame:
        return density(self.cpu(), ["pid"], "cpu_mean", grid)

    def memory_density(self, grid: int = 200) -> DataFrame:
        return density(self.memory(), ["pid"], "percent", grid)
