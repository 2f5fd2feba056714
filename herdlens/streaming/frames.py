"""Frames as they arrive: selection, scoring, and results per animal or per passage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.functions.clock import event_time
from herdlens.operators.scoring import MakePredict, mean_weights, score_enhanced
from herdlens.operators.selection import in_passage, is_suitable, suitable_frames


def running_weights(
    frames: DataFrame,
    make_predict: MakePredict,
    passage_time: float,
    window: float,
    shape: tuple[int, int],
    max_value: float,
    channels: int,
    period: str | None = None,
    delay: str = "1 hour",
) -> DataFrame:
    """Score each suitable frame when it arrives and keep the running mean per animal (update mode).

    Frames carry ``elapsed``, which the capture side knows. With ``period`` (as ``"1 day"``) the mean is per animal and
    ``period_start`` of the frames' ``ts``: once the watermark, the newest time less ``delay``, has passed a period its
    state goes, so the state of a stream without end stays in bounds. Without it the state is a row per animal for ever.
    """
    chosen = suitable_frames(frames, passage_time, window)
    if period is None:
        return mean_weights(score_enhanced(chosen, make_predict, max_value, shape, channels))
    timed = chosen.withColumn("at", event_time("ts")).withWatermark("at", delay)
    scored = score_enhanced(timed, make_predict, max_value, shape, channels)
    means = scored.groupBy("pid", "animal", F.window("at", period).alias("period")).agg(
        F.avg("weight").alias("mean_weight"), F.count("weight").alias("scored_images")
    )
    start = F.col("period.start").cast("timestamp_ntz").alias("period_start")
    return means.select("pid", "animal", start, "mean_weight", "scored_images")


def passage_scores(
    frames: DataFrame,
    keys: Sequence[str],
    gap_seconds: float,
    delay: str,
    make_predict: MakePredict,
    passage_time: float,
    window: float,
    shape: tuple[int, int],
    max_value: float,
    channels: int,
) -> DataFrame:
    """Raw frames to one row per passage: horizon, selection, enhancement, scoring, and ``passage_weights``.

    Only suitable frames are enhanced and scored; the others count without their pixels being touched.
    """
    counted = frames.where(in_passage(passage_time))
    chosen = counted.withColumn("pixels", F.when(is_suitable(window), F.col("pixels")))
    scored = score_enhanced(chosen, make_predict, max_value, shape, channels).drop("pixels")
    return passage_weights(scored, keys, gap_seconds, delay, window)


def passage_weights(
    frames: DataFrame, keys: Sequence[str], gap_seconds: float, delay: str, window: float, value: str = "weight"
) -> DataFrame:
    """One row per passage once it is over (append mode): frame counters and mean weight.

    A passage ends when no frame follows for ``gap_seconds``; it is emitted when the watermark, the
    newest time less ``delay``, has passed that end. Frames later than the watermark are dropped. Mean
    over suitable frames only; ``elapsed`` comes with the frames.
    """
    timed = frames.withColumn("at", event_time("ts")).withWatermark("at", delay)
    passage = F.session_window("at", f"{gap_seconds} seconds")
    suitable = is_suitable(window)
    return (
        timed.groupBy(*keys, passage)
        .agg(
            F.count(F.lit(1)).alias("total_of_images"),
            F.count_if(suitable).alias("suitable_images"),
            F.avg(F.when(suitable, F.col(value))).alias("mean_weight"),
        )
        .select(
            *keys,
            F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
            F.col("session_window.end").cast("timestamp_ntz").alias("session_end"),
            "total_of_images",
            "suitable_images",
            "mean_weight",
        )
    )
