"""Summary statistics per run and metric, with exact interpolated quartiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdlens.functions.values import nan_to_null
from herdlens.operators.grouped import join_groups
from herdlens.session import stage

QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}


def melt(df: DataFrame, keys: Sequence[str], metrics: Sequence[Column]) -> DataFrame:
    """Long form ``keys, metric, value`` with the metric's position as ``metric``; missing values left out.

    A position is smaller to hash, sort and shuffle than a name.
    """
    values = F.array(*(nan_to_null(c.cast("double")) for c in metrics))
    return df.select(*keys, F.posexplode(values).alias("metric", "value")).where(F.col("value").isNotNull())


def value_counts(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct values per key and how often each occurs. Repeated values fold before the shuffle."""
    return long.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


#: Bins of an octave, and of the range of one such bin.
PER_OCTAVE, BINS = 16, 1024


def _octave_bin(value: Column) -> Column:
    """A whole number that rises with the value and depends on nothing else."""
    size = F.least(F.abs(value), F.lit(1.7e308))
    place = F.floor(F.log2(size) * PER_OCTAVE) + F.lit(1100 * PER_OCTAVE)
    return F.when(value == 0, 0).otherwise(F.signum(value) * place).cast("int")


def _range_bin(value: Column, low: Column, high: Column) -> Column:
    """Which of BINS equal parts of a finite range a value lies in; an infinite one has its ends and the rest."""
    place = F.floor(F.try_divide(value - low, high - low) * BINS)
    ends = F.when(value == low, 0).when(value == high, BINS).otherwise(1)
    return F.when(F.abs(high - low) < F.lit(float("inf")), F.coalesce(place, F.lit(0))).otherwise(ends).cast("int")


def describe_long(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """``group, count, mean, std, min, p25, p50, p75, max`` of ``value``; linear quantiles, sample deviation.

    A grouped ``percentile`` would hold all distinct values of a group in one task, and sorting them is not needed
    either: values are counted in bins, which give count, mean and deviation as well; only bins that hold a wanted
    position go on, in finer bins over their own range; and what is left is sorted bin by bin. Exact at any distribution.
    """
    group = list(group)
    octaves = long.withColumn("octave", _octave_bin(F.col("value")))
    bins = octaves.groupBy(*group, "octave").agg(
        F.count(F.lit(1)).alias("held"), F.avg("value").alias("middle"), F.var_pop("value").alias("spread"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    every = Window.partitionBy(*group)
    totals = bins.withColumns(
        {
            "count": F.sum("held").over(every),
            "mean": F.sum(F.col("held") * F.col("middle")).over(every) / F.sum("held").over(every),
            "min": F.min("low").over(every),
            "max": F.max("high").over(every),
            "start": F.sum("held").over(every.orderBy("octave")) - F.col("held"),
        }
    )
    inner = F.col("held") * (F.col("spread") + F.pow(F.col("middle") - F.col("mean"), 2))
    totals = totals.withColumn("squares", F.sum(inner).over(every))
    positions = [
        (f"{name}_{end}", rounded(F.lit(q) * (F.col("count") - 1)).cast("bigint"))
        for name, q in QUARTILES.items()
        for end, rounded in (("low", F.floor), ("high", F.ceil))
    ]

    def here(position: Column) -> Column:
        return (F.col("start") <= position) & (position < F.col("start") + F.col("held"))

    wanted = reduce(lambda a, b: a | b, (here(p) for _, p in positions))
    stats = ["count", "mean", "squares", "min", "max"]
    chosen = totals.where(wanted).select(*group, "octave", "low", "high", F.col("start").alias("before"), *stats)
    rows = join_groups(octaves, chosen, [*group, "octave"]).withColumn("part", _range_bin(F.col("value"), F.col("low"), F.col("high")))
    by = [*group, "octave"]
    parts = rows.groupBy(*by, "part", "before", *stats).agg(F.count(F.lit(1)).alias("held"))
    # At most BINS + 1 rows a window.
    upto = F.sum("held").over(Window.partitionBy(*by).orderBy("part"))
    chosen = parts.withColumn("start", F.col("before") + upto - F.col("held")).where(wanted).select(*by, "part", F.col("start").alias("before"))
    by = [*by, "part"]
    values = join_groups(rows.drop("before"), chosen, by).groupBy(*by, "before", *stats, "value").agg(F.count(F.lit(1)).alias("held"))
    upto = F.sum("held").over(Window.partitionBy(*by).orderBy("value"))
    ranked = values.withColumn("start", F.col("before") + upto - F.col("held"))
    gathered = ranked.groupBy(*group, *stats).agg(*(F.max(F.when(here(p), F.col("value"))).alias(name) for name, p in positions))

    def between(name: str, q: float) -> Column:
        position = F.lit(q) * (F.col("count") - 1)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        part = position - F.floor(position)
        return F.when(part > 0, low + (high - low) * part).otherwise(low).alias(name)

    std = F.sqrt(F.try_divide(F.col("squares"), F.col("count") - 1))
    quartiles = [between(name, q) for name, q in QUARTILES.items()]
    return gathered.select(*group, "count", "mean", std.alias("std"), "min", *quartiles, "max")


def describe(
    df: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column], timestamps: Sequence[str] = (), keep: bool = False
) -> DataFrame:
    """``describe_long`` of named columns, one row per key and metric.

    ``timestamps`` names metrics (epoch microseconds) whose deviation is left NULL. The values are read three times: with
    ``keep`` they are written once, when this is called, which pays if they come from joins or windows.
    """
    long = melt(df, keys, list(metrics.values()))
    summary = describe_long(stage(long) if keep else long, [*keys, "metric"])
    named = summary.withColumn("metric", F.get(F.array(*(F.lit(name) for name in metrics)), "metric"))
    if timestamps:
        named = named.withColumn("std", F.when(~F.col("metric").isin(list(timestamps)), F.col("std")))
    return named
