"""Streaming results as written tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter


def _start(writer: DataStreamWriter, checkpoint: str, trigger: str | None) -> StreamingQuery:
    """Runs on a processing-time trigger, or with ``trigger=None`` over what is there and then stops."""
    timed = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return timed.option("checkpointLocation", checkpoint).start()


def append_table(results: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Final rows of windowed results, each written once."""
    return _start(results.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, trigger)


def change_table(
    results: DataFrame, path: str, checkpoint: str, trigger: str | None = None, keys: Sequence[str] = (), every: int = 20
) -> StreamingQuery:
    """Changed rows of running results, one folder per micro-batch; a repeated micro-batch overwrites its own.

    With ``keys`` the log is kept short: after every so many micro-batches the newest row per key goes into a snapshot
    (``compact``), and what two snapshots cover is deleted.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if keys and (batch + 1) % every == 0:
            compact(changed.sparkSession, path, keys, batch)

    return _start(results.writeStream.outputMode("update").foreachBatch(write), checkpoint, trigger)


#: Hidden from readers of the folder of changes.
_SNAPSHOTS = "_snapshots"


def _numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix<number>`` in a folder: names only are read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


def _ended(spark: SparkSession, path: str) -> bool:
    """Whether the job that writes a table has ended."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _changes(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The newest ended snapshot up to a micro-batch and the changes after it, with the number of each row's batch."""
    made = [n for n in _numbered(spark, f"{path}/{_SNAPSHOTS}", "upto=") if upto is None or n <= upto]
    base = max((n for n in made if _ended(spark, f"{path}/{_SNAPSHOTS}/upto={n}")), default=None)
    tail = [n for n in _numbered(spark, path, "batch=") if (base is None or n > base) and (upto is None or n <= upto)]
    found = [spark.read.option("basePath", path).parquet(*(f"{path}/batch={n}" for n in tail))] if tail else []
    if base is not None:
        snapshot = spark.read.parquet(f"{path}/{_SNAPSHOTS}/upto={base}")
        found.insert(0, snapshot.withColumn("batch", F.lit(base)))
    return reduce(DataFrame.unionByName, found) if found else None


def _newest(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def compact(spark: SparkSession, path: str, keys: Sequence[str], batch: int) -> None:
    """A snapshot of a change table up to a micro-batch, and the end of changes and snapshots before the last one.

    A repeated micro-batch finds the snapshot before and its own changes, which stay until the next one, and makes the
    same snapshot again; a snapshot counts once its job has ended; readers that have begun with the one before
    still find all they need.
    """
    made = _numbered(spark, f"{path}/{_SNAPSHOTS}", "upto=")
    before = [n for n in made if n < batch and _ended(spark, f"{path}/{_SNAPSHOTS}/upto={n}")]
    for n in made:
        if n >= batch:  # of an earlier try
            _delete(spark, f"{path}/{_SNAPSHOTS}/upto={n}")
    changes = _changes(spark, path, batch)
    if changes is None:
        return
    _newest(changes, keys).write.mode("overwrite").parquet(f"{path}/{_SNAPSHOTS}/upto={batch}")
    if before:
        for n in _numbered(spark, path, "batch="):
            if n <= max(before):
                _delete(spark, f"{path}/batch={n}")
        for n in before[:-1]:
            _delete(spark, f"{path}/{_SNAPSHOTS}/upto={n}")


def latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of a change table: its newest snapshot, if there is one, and the changes since."""
    changes = _changes(spark, path)
    return _newest(spark.read.parquet(path) if changes is None else changes, keys)


#: A time that no reading has: it ends a stream, or a run of one.
END = "2200-01-01 00:00:00"


def closable(rows: DataFrame, ends: str) -> DataFrame:
    """A stream that can be brought to its end: ``rows`` and whatever ``write_end`` puts into the folder ``ends``."""
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(ends)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(ends))


def write_end(rows: DataFrame, ends: str, timestamp: str, at: str = END, **given: object) -> None:
    """One row far in the future and otherwise NULL: the next run moves the watermark past all windows still open.

    To be called when no rows are to come; its own window stays open and is never emitted. ``given`` sets further
    columns, such as ``elapsed=0.0`` where a filter would drop the row.
    """
    known = {timestamp: at, **given}
    values = [F.lit(known.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    rows.sparkSession.range(1).select(*values).write.mode("append").parquet(ends)


def write_ends(rows: DataFrame, ends: str, keys: Sequence[str], timestamp: str) -> None:
    """One row for each key of ``rows``, far in the future and otherwise NULL: what is open of the key is then final.

    ``rows`` is a table; the key may go on afterwards, and rows before what was final are then late.
    """
    given = {timestamp: F.lit(END)}
    values = [F.col(f.name) if f.name in keys else given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    rows.select(*keys).distinct().select(*values).write.mode("append").parquet(ends)
