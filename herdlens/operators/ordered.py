"""Ordered operators per key (row number, running total, previous value) that split large keys.

``Window.partitionBy(key).orderBy(...)`` sends all rows of a key to one task. Here a large key is cut into buckets that
follow its order (``_cut``), windows work within buckets, and what a bucket needs from those before it (a row count, a
running total, the last value) is one edge row per bucket of a large key. All of it is one lazy plan of built-in
functions: nothing runs when an operator is called, and no row is staged. Buckets are a function of values and counts,
so a lost task gives the same ones again.

``slices`` range partitions rows by key and order instead, for scans in Arrow batches that read their slice once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.functions.clock import epoch_micros
from herdlens.operators.grouped import join_groups

#: Rows that one window sorts: beyond so many a key is cut.
BUCKET_ROWS = 1_000_000
_COARSE, _FINE, _CUT = "__coarse", "__fine", "__cut"
_INSIDE, _ROW, _EDGE, _BEFORE = "__inside", "__row", "__edge", "__before_bucket"


def starts_of_keys(batch: pa.RecordBatch, keys: Sequence[str], before: tuple | None) -> np.ndarray:
    """True where a row's key differs from the row above; ``before`` is the key above the first row."""
    changed = np.zeros(batch.num_rows, dtype=bool)
    for key in keys:
        column = batch.column(key)
        above, below = column.slice(0, batch.num_rows - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(above, below), False)
        null_edge = pc.not_equal(pc.is_null(above), pc.is_null(below))
        changed[1:] |= pc.or_(differs, null_edge).to_numpy(zero_copy_only=False)
    changed[0] = before is None or key_at(batch, keys, 0) != before
    return changed


def key_at(batch: pa.RecordBatch, keys: Sequence[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range partitioned by key and order, sorted inside each partition."""
    return df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)


def _position(df: DataFrame, column: str) -> Column | None:
    """A double that rises with the column (NaN and infinities at the ends), or None where there is no such number."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return epoch_micros(column).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.NumericType):
        return F.greatest(F.least(F.col(column).cast("double"), F.lit(1e300)), F.lit(-1e300))
    return None


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket_rows: int) -> DataFrame:
    """Adds ``__coarse`` and ``__fine``: buckets that follow the order within a key, and ``__cut`` where a key has several.

    Keys of more than ``bucket_rows`` rows are cut evenly over the range of the first column of the order; buckets that
    are still twice too large, in bursts, over their own range, or, at one instant, over the second column. The numbers
    of rows are counted for it; only large keys and buckets have a row in the tables joined here. A column of the order
    that is no number and no time cannot cut.
    """
    places = [_position(df, c) for c in order[:2]]
    if places[0] is None:
        return df.withColumns({_COARSE: F.lit(0).cast("bigint"), _FINE: F.lit(0).cast("bigint"), _CUT: F.lit(False)})
    first = places[0]
    second = places[1] if len(places) > 1 and places[1] is not None else first

    def share(place: Column, low: str, high: str) -> Column:
        """Which of ``__parts`` equal parts of a range; rows without a place come before all."""
        at = F.try_divide(place - F.col(low), F.col(high) - F.col(low))
        return F.when(place.isNull(), F.lit(-1)).otherwise(F.coalesce(F.floor(at * F.col("__parts")), F.lit(0))).cast("bigint")

    def sizes(rows: DataFrame, by: Sequence[str], most: int) -> DataFrame:
        ends = {"__low": F.min(first), "__high": F.max(first), "__low2": F.min(second), "__high2": F.max(second)}
        counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *(c.alias(n) for n, c in ends.items()))
        parts = F.ceil(F.col("__n") / F.lit(float(bucket_rows))).alias("__parts")
        return counted.where(F.col("__n") > most).select(*by, *ends, parts)

    extra = ["__low", "__high", "__low2", "__high2", "__parts"]
    large = join_groups(df, sizes(df, keys, bucket_rows), keys, "left").withColumn(_CUT, F.col("__parts").isNotNull())
    rows = large.withColumn(_COARSE, F.when(F.col(_CUT), share(first, "__low", "__high")).otherwise(0)).drop(*extra)
    by = [*keys, _COARSE]
    bursts = sizes(rows.where(_CUT), by, 2 * bucket_rows)
    within = F.when(F.col("__low") < F.col("__high"), share(first, "__low", "__high")).otherwise(share(second, "__low2", "__high2"))
    fine = F.when(F.col("__parts").isNull(), 0).otherwise(within).cast("bigint")
    return join_groups(rows, bursts, by, "left").withColumn(_FINE, fine).drop(*extra)


def _scanned(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket_rows: int, inside: Column, edge: Column, over_edges: Column) -> DataFrame:
    """``__inside``: a window function within each bucket; ``__before``: one over the edge rows of the buckets before."""
    rows = _cut(df, keys, order, bucket_rows)
    bucket = [*keys, _COARSE, _FINE]
    edges = rows.where(_CUT).groupBy(*bucket).agg(edge.alias(_EDGE))
    earlier = edges.select(*bucket, over_edges.alias(_BEFORE)).where(F.col(_BEFORE).isNotNull())
    number = F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))
    return join_groups(rows.withColumns({_INSIDE: inside, _ROW: number}), earlier, bucket, "left")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Row number from 1 within each key. End ``order`` with a unique column, so that ties split too."""
    bucket, over_edges = _windows(keys, order)
    total = F.sum(_EDGE).over(over_edges.rowsBetween(Window.unboundedPreceding, -1))
    scanned = _scanned(df, keys, order, bucket_rows, F.row_number().over(bucket).cast("bigint"), F.count(F.lit(1)), total)
    return scanned.select(*_names(df), (F.col(_INSIDE) + F.coalesce(_BEFORE, F.lit(0))).alias(name))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, name: str = "running_total", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Inclusive running sum of a non-null bigint column within each key."""
    bucket, over_edges = _windows(keys, order)
    inside = F.sum(weight).over(bucket.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(_EDGE).over(over_edges.rowsBetween(Window.unboundedPreceding, -1))
    scanned = _scanned(df, keys, order, bucket_rows, inside, F.sum(weight), total)
    return scanned.select(*_names(df), (F.col(_INSIDE) + F.coalesce(_BEFORE, F.lit(0))).alias(name))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str = "previous", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The value of ``column`` in the row before, within each key; NULL in a key's first row."""
    bucket, over_edges = _windows(keys, order)
    last = F.max_by(F.struct(F.col(f"`{column}`").alias("v")), F.struct(*(F.col(f"`{c}`") for c in order)))
    scanned = _scanned(df, keys, order, bucket_rows, F.lag(f"`{column}`").over(bucket), last, F.lag(_EDGE).over(over_edges))
    value = F.when(F.col(_ROW) == 1, F.col(f"{_BEFORE}.v")).otherwise(F.col(_INSIDE))
    return scanned.select(*_names(df), value.alias(name))


def _names(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def _windows(keys: Sequence[str], order: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """Rows of a bucket in order, and the buckets of a key in order."""
    return Window.partitionBy(*keys, _COARSE, _FINE).orderBy(*order), Window.partitionBy(*keys).orderBy(_COARSE, _FINE)
