"""Scalar and row-wise helpers on built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column | str) -> Column:
    """NaN counts as missing: it must not be counted, summed or ordered as the largest value."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(column), column)


def array_mean(values: Column) -> Column:
    """Mean of an array, skipping NULL and NaN; NULL if nothing is left."""
    kept = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(kept))


def row_mean(columns: Sequence[str]) -> Column:
    """Row-wise mean over ``columns`` with missing values skipped, without building an array."""
    clean = [nan_to_null(F.col(c).cast("double")) for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in clean[1:]), F.coalesce(clean[0], F.lit(0.0)))
    present = sum((c.isNotNull().cast("int") for c in clean[1:]), clean[0].isNotNull().cast("int"))
    return F.try_divide(total, present)


def signed(flag: Column, magnitude: Column) -> Column:
    """``-magnitude`` where the flag is 1, else ``magnitude``."""
    return F.when(flag == 1, -magnitude).otherwise(magnitude)


def scaled(raw: Column, unit: float) -> Column:
    """Raw counter to a physical unit."""
    return raw.cast("double") * F.lit(unit)


def kilo(value: Column) -> Column:
    """Base unit to its thousandfold (Wh to kWh)."""
    return value / F.lit(1000.0)
