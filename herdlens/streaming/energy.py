"""Energy of runs whose power readings keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from herdlens.functions.clock import epoch_micros
from herdlens.functions.values import kilo
from herdlens.operators.energy import energy_parts, join_parts

STATE_SCHEMA = "pid string, energy_wh double, last_us bigint, batch bigint"
_SALTS = 32


#: Versions of the state kept for a repeated micro-batch and for readers that have just begun.
_KEPT = 3


def _version(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """The state after one micro-batch, one row per run: that folder alone is read."""
    none = spark.createDataFrame([], STATE_SCHEMA).drop("batch")
    if batch < 0:
        return none
    return spark.read.schema(none.schema).parquet(f"{path}/batch={batch}")


def _forget(spark: SparkSession, path: str, batch: int) -> None:
    """Delete the version of a micro-batch that cannot be asked for any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _newest(spark: SparkSession, path: str) -> DataFrame:
    """The state of the newest micro-batch, among the few versions there are."""
    states = spark.read.schema(STATE_SCHEMA).parquet(path)
    newest = states.agg(F.max("batch").alias("batch"))  # one row
    return states.join(F.broadcast(newest), "batch", "left_semi").drop("batch")


def integrate_stream(readings: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Keeps ``energy_wh`` and the last instant of every run in a table of states under ``path``.

    Each micro-batch runs the batch operator, so a run that sends most of the readings is cut over
    tasks like any other large run. The state of a run enters as one more piece that ends at its last
    instant; readings not newer than that are late and left out, so no interval is ever negative.
    States are versioned by micro-batch, and a repeated micro-batch rewrites its own version from the
    one before, so each reading counts once. A micro-batch reads that one version and deletes an old one.
    """
    spark = readings.sparkSession
    spark.createDataFrame([], STATE_SCHEMA).write.mode("append").partitionBy("batch").parquet(path)

    def step(batch: DataFrame, batch_id: int) -> None:
        known = _version(batch.sparkSession, path, batch_id - 1)
        # Micro-batches run without adaptive skew splitting, so the lookup is salted by hand.
        salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
        state = known.select("pid", F.col("last_us").alias("known_us"), salts)
        salt = F.pmod(F.xxhash64("timestamp"), F.lit(_SALTS)).cast("int")
        salted = batch.withColumns({"pid": F.col("pid").cast("string"), "salt": salt})
        rows = salted.join(state, ["pid", "salt"], "left")
        fresh = rows.where(F.col("known_us").isNull() | (epoch_micros("timestamp") > F.col("known_us")))
        before = known.select(
            "pid",
            "energy_wh",
            F.col("last_us").alias("first_us"),
            F.lit(None).cast("double").alias("first_power"),
            "last_us",
        )
        joined = join_parts(before.unionByName(energy_parts(fresh)))
        joined.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if batch_id >= _KEPT:
            _forget(batch.sparkSession, path, batch_id - _KEPT)

    writer = readings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def stream_energy(spark: SparkSession, path: str) -> DataFrame:
    """``pid, energy_wh, energy_kwh`` as of the newest micro-batch."""
    state = _newest(spark, path)
    return state.select("pid", "energy_wh", kilo(F.col("energy_wh")).alias("energy_kwh"))
