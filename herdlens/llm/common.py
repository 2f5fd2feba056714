"""What the operators share: tables, folds, written stages, and columns computed from Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.session import configure, shared_folder

FOLDS = 5


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder; the session gets the settings the operators count on."""
    configure(spark)
    # Whole texts travel in these batches: few rows each, so that a batch of long ones stays in bounds.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str) -> Column:
    """0 to 4 by the CRC of the key's text; fold 0 is held out everywhere."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


def held_out(key: str) -> Column:
    return F.coalesce(fold(key) == 0, F.lit(False))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: the rows as a Parquet table in the shared folder, which lost executors do not take along."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting for the jobs inside; the caller's session has its own again afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not got in any case."""
    taken = {c.lower() for c in df.columns}
    made = f"__{name}__"
    while made in taken:
        made += "_"
    return made


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` once their last reader has written its own result."""
    for table_ in tables:
        spark = table_.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in table_.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(name)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if tables:
        swept(tables[0].sparkSession)


def swept(spark: SparkSession) -> None:
    """Shuffle files of past jobs stay until the driver collects its garbage, so both of its languages are asked to."""
    gc.collect()
    spark._jvm.System.gc()


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def append(df: DataFrame, fields: list[T.StructField], text: str, compute: Callable[..., list[pa.Array]], key: Column | None = None) -> DataFrame:
    """``df`` with columns computed from one text column, batch by batch.

    ``compute`` gets strings without nulls (a null text counts as empty), and the values of ``key`` if given. A column
    of ``df`` that is named like a new one is replaced.
    """
    new = {f.name for f in fields}
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    # Columns are read by place, under names that ``df`` has not got.
    given = [F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(unused(df, "text")), *([] if key is None else [key.alias(unused(df, "key"))])]
    source = df.select(*(F.col(f"`{c}`") for c in kept), *given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = compute(*batch.columns[len(kept) :])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*kept, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


#: Rows of all classes that a model is trained on at most (one of each class at least), and bytes of a text among them.
MOST_ROWS, MOST_BYTES = 20_000, 1 << 16


def sample_per_class(rows: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """About ``per_class`` (key, label) rows of each class, less if there are very many classes, chosen by a hash of the key.

    The counts cover all rows; only the choice of training rows is a sample, the same in every run.
    """
    counts = written(rows.groupBy(F.col(label).alias("__class__")).agg(F.count("*").alias("__rows__")), "classes")
    classes = max(1, counts.count())
    each = max(1, min(per_class, MOST_ROWS // classes))
    number = F.xxhash64(F.col(key))
    share = F.pmod(number, F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(counts, F.col(label) == F.col("__class__")).where(share < F.lit(float(each)) / F.col("__rows__"))
    return chosen.orderBy(number, key, label).limit(2 * each * classes).drop("__class__", "__rows__")


def chunks(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together, one row at least."""
    begin, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield begin, len(lengths)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offset of each text (one more than texts)."""
    if pa.types.is_large_string(texts.type):
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    else:
        texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
