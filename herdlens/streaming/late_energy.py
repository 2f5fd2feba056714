"""Energy of runs whose power readings arrive in any order.

State per run: readings of the newest ``lateness``, each as it came, and before that one piece per time bucket (energy,
first and last reading). A late reading among the recent ones is just another one; an older one starts a bucket that had
none, or goes before or after the piece of its bucket, and neighbouring pieces are joined when totals are read. Only a
reading that falls inside a finished piece cannot be placed any more: it goes to a side table. So any order of
files gives the total of the batch form as long as no reading is older than ``lateness`` and lies between two that
came before it and share its bucket.

All steps go by (run, bucket), so a run that sends most readings is spread like many runs. The state is versioned by
micro-batch: a repeated one starts again from the version before and rewrites its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from herdlens.functions.clock import epoch_micros, hours, micros
from herdlens.functions.values import kilo, nan_to_null
from herdlens.operators.energy import energy_parts, join_parts
from herdlens.streaming.tables import _delete, _ended, _numbered

PIECES = "pid string, bucket bigint, energy_wh double, first_us bigint, first_power double, last_us bigint"
RECENT = "pid string, us bigint, power double"
_SALTS = 32
_KEPT = 3
_PLACE = ["pid", "bucket"]


def _read(spark: SparkSession, path: str, batch: int, name: str, schema: str) -> DataFrame:
    if batch < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={batch}/{name}")


def _at(column: str = "us") -> Column:
    """Microseconds since 1970 as a naive timestamp."""
    return F.timestamp_micros(column).cast("timestamp_ntz")


def _pieces(instants: DataFrame, *keys: str) -> DataFrame:
    """Pieces of (keys, us, power) rows: the batch operator over a run's buckets, each as a run of its own."""
    named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    parts = energy_parts(instants.select(named.alias("pid"), _at().alias("timestamp"), F.col("power").alias("Power[W]")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in instants.select(*keys).schema.fields)
    return parts.withColumn("k", F.from_json("pid", kinds)).select("k.*", "energy_wh", "first_us", "first_power", "last_us")


def _joined(parts: DataFrame) -> DataFrame:
    """Time-disjoint pieces of one bucket as one piece."""
    before = F.lag("last_us").over(Window.partitionBy(*_PLACE).orderBy("first_us"))
    bridge = F.coalesce(F.col("first_power") * hours(F.col("first_us") - before), F.lit(0.0))
    return parts.withColumn("bridge", bridge).groupBy(*_PLACE).agg(
        F.sum(F.col("energy_wh") + F.col("bridge")).alias("energy_wh"),
        F.min("first_us").alias("first_us"),
        F.min_by("first_power", "first_us").alias("first_power"),
        F.max("last_us").alias("last_us"),
    )


def _beside_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` with what their run has; micro-batches split no hot key by themselves, so the lookup is salted."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")
    own = runs.select(F.col("pid").alias("run"), *(c for c in runs.columns if c != "pid"), salts)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("us"), F.lit(_SALTS)).cast("int"))
    same = F.col("pid").eqNullSafe(F.col("run")) & (salted["salt"] == own["salt"])
    return salted.join(own, same, "left").drop("run", "salt")


def integrate_any_order(
    readings: DataFrame, path: str, checkpoint: str, lateness: str = "1 day", bucket: str = "1 hour", trigger: str | None = None
) -> StreamingQuery:
    """Keeps the state under ``path``; ``energy_so_far`` sums it up, ``late_readings`` lists what had no place."""
    width, back = micros(bucket), micros(lateness)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known, recent = (_read(spark, path, batch_id - 1, *x) for x in (("pieces", PIECES), ("recent", RECENT)))
        of_bucket = F.floor(F.col("us") / width).cast("bigint").alias("bucket")
        fresh = (
            batch.where(F.col("timestamp").isNotNull())
            .groupBy(F.col("pid").cast("string").alias("pid"), epoch_micros("timestamp").alias("us"))
            .agg(F.min(nan_to_null(F.col("Power[W]").cast("double"))).alias("power"))
            .select("*", of_bucket)
        )
        spans = known.select(F.col("pid").alias("run"), F.col("bucket").alias("at"), "first_us", "last_us")
        same = F.col("pid").eqNullSafe(F.col("run")) & (F.col("bucket") == F.col("at"))
        placed = fresh.join(spans, same, "left").drop("run", "at").withColumn("lost", F.coalesce(F.col("us").between(F.col("first_us"), F.col("last_us")), F.lit(False)))
        here = f"{path}/batch={batch_id}"
        placed.write.mode("overwrite").parquet(f"{here}/placed")
        placed = spark.read.schema(placed.schema).parquet(f"{here}/placed")
        placed.where("lost").select("pid", _at().alias("timestamp"), F.col("power").alias("Power[W]")).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        side = F.when(F.col("us") > F.col("last_us"), 1).otherwise(0).alias("side")
        rows = placed.where("NOT lost").select("pid", "us", "power", "bucket", side)
        # Readings of one instant that came in different micro-batches are one reading.
        rows = rows.unionByName(recent.select("*", of_bucket, F.lit(0).alias("side"))).groupBy("pid", "us", "bucket", "side").agg(F.min("power").alias("power"))
        ends = rows.select("pid", F.col("us").alias("newest")).unionByName(known.select("pid", F.col("last_us").alias("newest")))
        closed = F.floor((F.max("newest") - back) / width).cast("bigint").alias("closed")
        rows = _beside_runs(rows, ends.groupBy("pid").agg(closed))
        old = F.col("bucket") < F.col("closed")
        rows.where(~old).select("pid", "us", "power").write.mode("overwrite").parquet(f"{here}/recent")
        parts = _pieces(rows.where(old), "pid", "bucket", "side").drop("side")
        _joined(known.unionByName(parts)).write.mode("overwrite").parquet(f"{here}/pieces")
        for n in _numbered(spark, path, "batch="):
            if n <= batch_id - _KEPT:
                _delete(spark, f"{path}/batch={n}")

    writer = readings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def _newest(spark: SparkSession, path: str) -> int:
    """The newest micro-batch whose last table is whole, so that a reader never meets one that is being written."""
    return max((n for n in _numbered(spark, path, "batch=") if _ended(spark, f"{path}/batch={n}/pieces")), default=-1)


def energy_so_far(spark: SparkSession, path: str) -> DataFrame:
    """``pid, energy_wh, energy_kwh`` of all readings but those of ``late_readings``."""
    newest = _newest(spark, path)
    known, recent = (_read(spark, path, newest, *x) for x in (("pieces", PIECES), ("recent", RECENT)))
    parts = energy_parts(recent.select("pid", _at().alias("timestamp"), F.col("power").alias("Power[W]")))
    totals = join_parts(known.drop("bucket").unionByName(parts))
    return totals.select("pid", "energy_wh", kilo(F.col("energy_wh")).alias("energy_kwh"))


def late_readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings that fell inside a finished piece."""
    return spark.read.schema("pid string, timestamp timestamp_ntz, `Power[W]` double").parquet(f"{path}/late/batch=*")
