"""Timing metrics per animal and per run, and the comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herdlens.functions.clock import hours, micros_between, seconds
from herdlens.operators.flatten import RUN_TIMES, with_durations
from herdlens.operators.grouped import join_groups


def animal_metrics(rows: DataFrame) -> DataFrame:
    """One row per (run, animal) from flat image rows; combines map-side, so a long passage is no hot spot."""
    return (
        with_durations(rows)
        .groupBy("pid", "animal")
        .agg(
            *(F.min(c).alias(c) for c in RUN_TIMES),
            F.min("first_image_capture_time").alias("first_image_capture_time"),
            F.max("last_image_capture_time").alias("last_image_capture_time"),
            F.max("display_time").alias("display_time"),
            F.count(F.lit(1)).alias("image_rows"),
            F.max("total_of_images").alias("total_of_images"),
            F.max("suitable_images").alias("suitable_images"),
            F.coalesce(F.sum("weight_prediction_dur_us"), F.lit(0)).alias("processing_delay_us"),
        )
        .withColumn("lead_time_us", micros_between("first_image_capture_time", "display_time"))
        .withColumn("latency_us", micros_between("last_image_capture_time", "display_time"))
    )


def run_metrics(animals: DataFrame) -> DataFrame:
    """One row per run from ``animal_metrics``: every animal counts once, however many images it has."""
    return (
        animals.groupBy("pid")
        .agg(
            F.count(F.lit(1)).alias("animals"),
            micros_between(F.min("first_image_capture_time"), F.max("display_time")).alias("collect_lead_time_us"),
            F.sum("processing_delay_us").alias("total_processing_delay_us"),
            F.avg("latency_us").alias("mean_latency_us"),
            micros_between(F.min("load_model_start"), F.min("load_model_final")).alias("load_model_dur_us"),
            F.sum("total_of_images").alias("total_of_images"),
            F.sum("suitable_images").alias("suitable_images"),
        )
        .withColumn("throughput_per_hour", F.try_divide(F.col("animals"), hours("collect_lead_time_us")))
        .withColumn("fps", F.try_divide(F.col("total_of_images"), seconds("collect_lead_time_us")))
    )


def image_rows_with_metrics(rows: DataFrame) -> DataFrame:
    """Image rows joined to their animal's metrics and their run's scalars.

    The two aggregate levels meet first, so the image rows move once.
    """
    animals = animal_metrics(rows)
    per_animal = animals.select("pid", "animal", "lead_time_us", "processing_delay_us", "latency_us")
    per_run = run_metrics(animals).select("pid", "collect_lead_time_us", "throughput_per_hour")
    return join_groups(with_durations(rows), join_groups(per_animal, per_run, ["pid"]), ["pid", "animal"])


def compare_runs(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Run metrics beside the run's settings, with the difference to the run its ``baseline_pid`` names.

    Every measured run stays: without a settings row its settings and differences are NULL.
    """
    measures = ["collect_lead_time_us", "total_processing_delay_us", "mean_latency_us", "throughput_per_hour", "fps"]
    baseline = metrics.select(
        F.col("pid").alias("baseline_pid"), *(F.col(m).alias(f"{m}_baseline") for m in measures)
    )
    deltas = {f"{m}_delta": F.col(m) - F.col(f"{m}_baseline") for m in measures}
    settled = join_groups(metrics, runs, ["pid"], "left")
    return settled.join(baseline, ["baseline_pid"], "left").withColumns(deltas)


def first_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)


def first_rows_per_run(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows of each run; Spark keeps ``n`` per run in each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)
