"""Frame selection and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.functions.clock import micros_between, seconds
from herdlens.operators.grouped import attach
from herdlens.operators.ordered import number_rows

PASSAGE = ["pid", "animal"]


def with_elapsed(frames: DataFrame) -> DataFrame:
    """Adds ``elapsed``: seconds since the animal's first frame.

    Frame tables usually bring ``elapsed`` from the capture side. Where they do not, call this without
    the pixels: with very many animals the join moves the rows.
    """
    started = attach(frames, PASSAGE, F.min("ts").alias("passage_start"))
    return started.withColumn("elapsed", seconds(micros_between("passage_start", "ts"))).drop("passage_start")


def with_ordinal(frames: DataFrame, *tie: str) -> DataFrame:
    """Adds ``img``: the frame's number within its animal, from 1, by time."""
    return number_rows(frames, PASSAGE, ["ts", *tie], "img")


def in_passage(passage_time: float) -> Column:
    """The horizon of a passage is exclusive."""
    return F.col("elapsed") < F.lit(float(passage_time))


def is_suitable(window: float) -> Column:
    """The selection window is inclusive."""
    return F.col("elapsed") <= F.lit(float(window))


def suitable_frames(frames: DataFrame, passage_time: float, window: float) -> DataFrame:
    """Frames worth scoring. Filter before enhancing: the pixels of the others are then never touched."""
    return frames.where(in_passage(passage_time) & is_suitable(window))


def frame_counters(frames: DataFrame, passage_time: float, window: float) -> DataFrame:
    """Captured and suitable frames per animal, with the times of its first and last frame."""
    captured = frames.where(in_passage(passage_time))
    return captured.groupBy(*PASSAGE).agg(
        F.count(F.lit(1)).alias("total_of_images"),
        F.count_if(is_suitable(window)).alias("suitable_images"),
        F.min("ts").alias("first_image_capture_time"),
        F.max("ts").alias("last_image_capture_time"),
    )
