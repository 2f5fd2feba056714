"""Session settings, the shared folder and durable staging."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Timestamps are naive local times; a fixed zone keeps the event-time casts of the streams exact.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One run or animal may hold a large share of all rows: split its side of a join at run time, even
    # where the split costs a further exchange for the aggregate that follows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Session windows over streams merge inside each input partition first, so a busy animal sends a
    # few partial sessions instead of all its frames.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators count on.

    Functions of this package travel to the executors by value, so it need not be installed there.
    """
    cloudpickle.register_pickle_by_value(sys.modules["herdlens"])
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _base_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode, where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{_base_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` durably, so that several readers see the same rows in the same partitions."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_base_folder(spark))
    return df.checkpoint(eager=True)
