"""The given tables seen as run telemetry: each function maps one table to one of the domain's shapes.

Every row of the table is used, so the work of a query grows with its table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.operators.flatten import FLAT_COLUMNS
from herdlens.operators.grouped import attach
from herdlens.operators.selection import PASSAGE

# Settings of the stand-in runs: seconds, sized to the 30 days that the events span.
PASSAGE_TIME = 1_728_000.0
WINDOW = 864_000.0
GAP = 1_800.0
# For frames that come a second apart.
RAW_PASSAGE = 400.0
RAW_WINDOW = 200.0

# An invented key; a real device's key is the caller's to give.
DEMO_KEY = bytes(range(32))
OTHER_KEY = bytes(range(1, 33))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"  # a stream takes a single file only by way of a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def power_readings(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("pid"),
        F.col("ts").alias("timestamp"),
        F.col("value").alias("Power[W]"),
        "event_id",
    )


def wide_readings(events: DataFrame) -> DataFrame:
    """All columns of the meter log, each with no more digits than its format keeps."""
    return events.select(
        F.col("event_type").alias("pid"),
        F.col("ts").alias("timestamp"),
        (F.pmod("event_id", F.lit(1000)) + F.lit(0.5)).alias("Time[S]"),
        (F.round(F.col("value") * 100) / 10000).alias("Volt[V]"),
        (F.round(F.col("value") * 100) / 100000).alias("Current[A]"),
        F.col("value").alias("Power[W]"),
        (F.round(F.col("value") * 10) / 10).alias("Res[Ohm]"),
        F.col("event_id").alias("G0[mAh]"),
        (F.col("event_id") * 5).alias("G0[mWh]"),
        F.col("user_id").alias("G1[mAh]"),
        (F.col("user_id") * 5).alias("G1[mWh]"),
        (F.pmod("user_id", F.lit(50)) - 25).alias("Temp[C]"),
        (F.pmod("event_id", F.lit(300)) / 100).alias("D+[V]"),
        (F.pmod("user_id", F.lit(300)) / 100).alias("D-[V]"),
    )


def frame_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.pmod("user_id", F.lit(3)).cast("string").alias("pid"),
        F.col("user_id").cast("int").alias("animal"),
        "ts",
        "event_id",
        F.col("value").alias("weight"),
    )


def image_rows(events: DataFrame) -> DataFrame:
    """Flat report rows: one image per event, predicted ``value`` milliseconds after its capture."""
    frames = frame_events(events)
    final = F.timestamp_add("MICROSECOND", F.round(F.col("weight") * 1000).cast("bigint"), F.col("ts"))
    timed = frames.withColumns({"weight_prediction_start": F.col("ts"), "weight_prediction_final": final})
    loaded = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = attach(
        timed,
        PASSAGE,
        F.min("ts").alias("first_image_capture_time"),
        F.max("ts").alias("last_image_capture_time"),
        F.max("weight_prediction_final").alias("display_time"),
        F.count(F.lit(1)).alias("total_of_images"),
        F.count_if(F.col("weight") <= 50).alias("suitable_images"),
    )
    return rows.select(
        "*",
        F.col("event_id").cast("int").alias("img"),
        loaded.alias("load_model_start"),
        F.timestamp_add("SECOND", F.col("pid").cast("int") + 5, loaded).alias("load_model_final"),
    ).select(*FLAT_COLUMNS)


def run_settings(spark: SparkSession) -> DataFrame:
    """The settings of the three stand-in runs, each compared with run 0."""
    rows = [
        ("0", "batch", 10.0, 3.0, 3.0, "0"),
        ("1", "batch", 5.0, 3.0, 3.0, "0"),
        ("2", "single", 5.0, 3.0, 2.0, "0"),
    ]
    schema = "pid string, strategy string, passage_time double, arrival_time double, window double, baseline_pid string"
    return spark.createDataFrame(rows, schema)


def frames(embeddings: DataFrame) -> DataFrame:
    """8 x 8 one-channel frames with values on both sides of the clip limit."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return embeddings.select(
        F.pmod("label", F.lit(3)).cast("string").alias("pid"),
        F.col("label").alias("animal"),
        F.col("vec_id").cast("int").alias("img"),
        F.timestamp_add("SECOND", "vec_id", start).alias("ts"),
        (F.get("embedding", F.lit(0)).cast("double") * 10 + 5).alias("elapsed"),
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.transform("embedding", lambda x: ((x.cast("double") + 1) * 2000).cast("float")).alias("pixels"),
    )


def whole_frames(embeddings: DataFrame) -> DataFrame:
    """The same frames with whole numbers as a camera gives them."""
    return frames(embeddings).withColumn("pixels", F.transform("pixels", lambda x: F.round(x)))


def cpu(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_linenumber").cast("string").alias("pid"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("cpu_core_0"),
        F.col("l_extendedprice").alias("cpu_core_1"),
        F.col("l_discount").alias("cpu_core_2"),
        F.col("l_tax").alias("cpu_core_3"),
    )


def memory(orders: DataFrame) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        F.pmod(customer, F.lit(5)).cast("string").alias("pid"),
        F.col("o_orderdate").alias("timestamp"),
        (key * 4096).alias("total"),
        (key * 1024).alias("available"),
        (key * 3072).alias("used"),
        (F.round("o_totalprice") / 10).alias("percent"),
        (customer * 7).alias("free"),
        (customer * 11).alias("active"),
        (customer * 13).alias("inactive"),
        customer.alias("buffers"),
        key.alias("cached"),
    )


def gpu(events: DataFrame) -> DataFrame:
    padded = F.concat(F.lit("  "), "event_type", F.lit(" "))
    return events.select(
        F.pmod("user_id", F.lit(4)).cast("string").alias("pid"),
        F.col("ts").alias("timestamp"),
        padded.alias("gpu_usage"),
        F.concat(F.lit("gpu="), F.col("user_id").cast("string")).alias("gpu_memor"),
        F.concat(F.lit(" volt="), F.col("event_id").cast("string")).alias("gpu_volts"),
        F.col("props").alias("gpu_tempr"),
    )


def _octets(value: Column) -> Column:
    """Little-endian hex text of an unsigned 32-bit number."""
    padded = F.lpad(F.hex(value.cast("bigint")), 8, "0")
    return F.concat(*(F.substring(padded, at, 2) for at in (7, 5, 3, 1)))


def packets(events: DataFrame) -> DataFrame:
    """A meter packet per event. Those of ``error`` events are cut short, those of ``view`` have a foreign key."""
    cents = F.round(F.col("value") * 100)
    user = F.col("user_id")

    def pack(name: str, *texts: str, **words: Column) -> Column:
        given = [F.lit(t.encode().hex()) for t in (name, *texts)]
        empty = F.lit("00000000")
        numbers = [_octets(words[f"w{i}"]) if f"w{i}" in words else empty for i in range(len(given), 16)]
        return F.concat(*given, *numbers)

    first = pack("pac1", "MTR1", "1.14", w3=F.col("event_id"), w11=user, w12=cents, w13=cents, w14=cents)
    second = pack(
        "pac2",
        w1=cents,
        w2=F.col("event_id"),
        w3=F.col("event_id") * 5,
        w4=user,
        w5=user * 5,
        w6=F.pmod(user, F.lit(2)),
        w7=F.pmod(user, F.lit(50)),
        w8=F.pmod("event_id", F.lit(300)),
        w9=F.pmod(user, F.lit(300)),
    )
    plain = F.unhex(F.concat(first, second, pack("pac3")))
    key = F.when(F.col("event_type") == "view", F.lit(OTHER_KEY)).otherwise(F.lit(DEMO_KEY))
    length = F.when(F.col("event_type") == "error", 100).otherwise(192)
    sealed = F.aes_encrypt(plain, key, F.lit("ECB"), F.lit("PKCS"))  # the padding block is cut off
    return events.select("event_id", "event_type", F.substring(sealed, F.lit(1), length).alias("packet"))


def recordings(events: DataFrame) -> DataFrame:
    """A recording per event: up to three pairs, a full buffer of 1,440 for every 250th event, and a partial pair."""
    full = F.pmod("event_id", F.lit(250)) == 7
    pairs = F.when(full, F.lit(1440)).otherwise(F.pmod("user_id", F.lit(4))).cast("int")
    cents = F.round(F.col("value") * 100)
    body = F.when(
        pairs > 0, F.transform(F.sequence(F.lit(1), pairs), lambda i: F.concat(_octets(cents * i), _octets(cents + i)))
    ).otherwise(F.array().cast("array<string>"))
    blob = F.unhex(F.concat(F.array_join(body, ""), F.lit("0A0B0C")))
    return events.select(F.pmod("user_id", F.lit(3)).cast("string").alias("pid"), "event_id", blob.alias("blob"))


def linear_model(size: int):
    """A model factory for checks: a fixed weight per pixel of the first channel."""

    def make_predict():
        weights = (np.arange(size) * 37 % 11 - 5) / 10.0

        def predict(batch: np.ndarray) -> np.ndarray:
            first = batch[..., 0] if batch.ndim == 4 else batch
            return (first.reshape(len(first), -1).astype(np.float64) @ weights).astype(np.float32)

        return predict

    return make_predict

