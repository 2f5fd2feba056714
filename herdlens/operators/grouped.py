"""Group values put back on the rows of the group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with their group's values beside them; a NULL key is a key like any other.

    ``groups`` has one narrow row per group. Nothing runs when this is called: adaptive execution sends the groups to
    every task if they turn out small in bytes, and else joins by key.
    """
    renamed = groups.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return rows.join(renamed, same, how).drop(*(f"__{k}" for k in keys))


def attach(rows: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Rows with their group's aggregates beside them.

    An aggregate and a join instead of an unordered window: the aggregate combines before its shuffle,
    where a window would bring a key with a large share of the rows whole into one task.
    """
    return join_groups(rows, rows.groupBy(*keys).agg(*aggregates), keys)
