"""The numbers behind distribution and line charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.functions.values import nan_to_null
from herdlens.operators.grouped import join_groups
from herdlens.operators.summary import value_counts

_SUMS_PER_ROW = 50


def _present(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    value = nan_to_null(F.col(column).cast("double"))
    return df.select(*keys, value.alias("value")).where(F.col("value").isNotNull())


def histogram(df: DataFrame, keys: Sequence[str], column: str, bins: int) -> DataFrame:
    """``keys, bin, bin_low, bin_high, n`` with equal widths over each group's range, empty bins included.

    The last bin is closed. A group whose values are all equal gets a range one unit wide around them.
    """
    values = _present(df, keys, column)
    flat = F.min("value") == F.max("value")
    half = F.when(flat, F.lit(0.5)).otherwise(F.lit(0.0))
    ranges = values.groupBy(*keys).agg((F.min("value") - half).alias("low"), (F.max("value") + half).alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    position = F.floor((F.col("value") - F.col("low")) / width).cast("int")
    counted = (
        join_groups(values, ranges, keys)
        .groupBy(*keys, F.least(F.lit(bins - 1), position).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    numbers = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    every_bin = ranges.select(*keys, "low", width.alias("width"), numbers)
    return join_groups(every_bin, counted, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_low"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _weighed_bins(values: DataFrame, ranges: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """``keys, value, n``: values shared out to the two nearest of ``bins`` even points, the nearer one getting more."""
    place = F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")) * F.lit(bins - 1)
    below = F.least(F.floor(place), F.lit(bins - 2))
    share = F.coalesce(place - below, F.lit(0.0))
    ends = F.array(
        F.struct(F.coalesce(below, F.lit(0)).alias("bin"), (1 - share).alias("w")),
        F.struct((F.coalesce(below, F.lit(0)) + 1).alias("bin"), share.alias("w")),
    )
    placed = join_groups(values, ranges.select(*keys, "low", "high"), keys).withColumn("end", F.explode(ends))
    counted = placed.groupBy(*keys, "low", "high", "end.bin").agg(F.sum("end.w").alias("n"))
    at = F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / F.lit(float(bins - 1))
    return counted.select(*keys, at.alias("value"), "n")


def density(df: DataFrame, keys: Sequence[str], column: str, grid: int = 200, bins: int | None = None) -> DataFrame:
    """``keys, point, x, density``: Gaussian kernel density on an even grid over each group's range.

    Bandwidth is the sample deviation times ``n ** (-1/5)``; a group without spread has NULL density.
    Values meet grid points as aggregate expressions over weighted distinct values, so no row is paired
    with another and the sums combine before the shuffle.

    With ``bins`` values are first shared out to so many even points of the group's range (linear binning), and those
    meet the grid: the kernel is then worked out ``bins`` x ``grid`` times a group, however many values it has. Each
    density differs from the exact one by at most ``d * d / (8 * sqrt(2 * pi) * h ** 3)``, where d is the distance of two
    points and h the bandwidth.
    """
    values = _present(df, keys, column)
    spread = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.stddev_samp("value").alias("deviation"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )
    bandwidth = F.nullif(F.col("deviation") * F.pow(F.col("total"), F.lit(-0.2)), F.lit(0.0))
    step = (F.col("high") - F.col("low")) / F.lit(float(max(grid - 1, 1)))
    frame = spread.select(*keys, "total", "low", step.alias("step"), bandwidth.alias("bandwidth"))
    chunks = -(-grid // _SUMS_PER_ROW)
    spread_out = (
        join_groups(_weighed_bins(values, spread, keys, bins) if bins else value_counts(values, keys), frame, keys)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    )
    offset = F.col("low") - F.col("value")

    def kernel_sum(j: int) -> Column:
        point = F.col("chunk") * _SUMS_PER_ROW + j
        scaled = (offset + point * F.col("step")) / F.col("bandwidth")
        return F.sum(F.col("n") * F.exp(scaled * scaled * F.lit(-0.5))).alias(f"s{j}")

    sums = spread_out.groupBy(*keys, "chunk").agg(*(kernel_sum(j) for j in range(_SUMS_PER_ROW)))
    points = sums.select(
        *keys, "chunk", F.posexplode(F.array(*(f"s{j}" for j in range(_SUMS_PER_ROW)))).alias("j", "total_kernel")
    ).select(*keys, (F.col("chunk") * _SUMS_PER_ROW + F.col("j")).alias("point"), "total_kernel")
    scale = F.col("total") * F.col("bandwidth") * F.sqrt(F.lit(2.0) * F.pi())
    return (
        join_groups(points.where(F.col("point") < grid), frame, keys)
        .select(
            *keys,
            "point",
            (F.col("low") + F.col("point") * F.col("step")).alias("x"),
            (F.col("total_kernel") / scale).alias("density"),
        )
    )


def line_series(
    df: DataFrame, keys: Sequence[str], timestamp: str, column: str, every: str | None = None
) -> DataFrame:
    """One mean per instant (or per ``every`` window), ordered by time within each key."""
    at = F.window(timestamp, every).start if every else F.col(timestamp)
    means = df.groupBy(*keys, at.alias("timestamp")).agg(F.avg(nan_to_null(F.col(column).cast("double"))).alias("mean"))
    return means.orderBy(*keys, "timestamp")
