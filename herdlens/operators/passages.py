"""Passages of animals: runs of frames with no gap longer than the idle time between animals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from herdlens.functions.clock import SECOND_US, epoch_micros, micros_between
from herdlens.functions.values import nan_to_null
from herdlens.operators.grouped import join_groups


#: Slots of gap width that one window holds at most.
SLOTS = 4096


def passage_sessions(
    frames: DataFrame,
    keys: Sequence[str],
    gap_seconds: float,
    timestamp: str = "ts",
    value: str = "weight",
    slots_per_part: int = SLOTS,
) -> DataFrame:
    """``keys, session_start, session_last, frames, mean_weight`` per passage, as a session window cuts them.

    Two frames in one slot of gap width are always in the same passage, so frames fold into slots
    before the shuffle, exactly. Slots are ordered within parts of ``slots_per_part``; a part hands on
    one row (its last frame, its number of passages) to the parts of the key that follow. So one key
    over a very long time is many small windows and a short one over parts.
    """
    gap_us = int(gap_seconds * SECOND_US)
    weight = nan_to_null(F.col(value).cast("double"))
    slots = (
        frames.where(F.col(timestamp).isNotNull())
        .groupBy(*keys, F.floor(epoch_micros(timestamp) / gap_us).alias("slot"))
        .agg(
            F.min(timestamp).alias("first"),
            F.max(timestamp).alias("last"),
            F.count(F.lit(1)).alias("frames"),
            F.sum(weight).alias("total"),
            F.count(weight).alias("weighed"),
        )
        .withColumn("part", F.floor(F.col("slot") / slots_per_part))
    )
    part = [*keys, "part"]
    inside, over_parts = Window.partitionBy(*part).orderBy("slot"), Window.partitionBy(*keys).orderBy("part")
    ends = slots.groupBy(*part).agg(F.max_by("last", "slot").alias("end"))
    ends = ends.withColumn("end", F.lag("end").over(over_parts))
    before = F.coalesce(F.lag("last").over(inside), "end")
    opens = F.coalesce(micros_between(before, "first") > gap_us, F.lit(True)).cast("int")
    opened = join_groups(slots, ends, part).withColumn("opens", opens)
    earlier = opened.groupBy(*part).agg(F.sum("opens").alias("earlier"))
    earlier = earlier.withColumn("earlier", F.sum("earlier").over(over_parts) - F.col("earlier"))
    numbered = join_groups(opened, earlier, part).withColumn("session", F.col("earlier") + F.sum("opens").over(inside))
    return (
        numbered.groupBy(*keys, "session")
        .agg(
            F.min("first").alias("session_start"),
            F.max("last").alias("session_last"),
            F.sum("frames").alias("frames"),
            F.try_divide(F.sum("total"), F.sum("weighed")).alias("mean_weight"),
        )
        .drop("session")
    )
