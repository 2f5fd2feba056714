"""CSV logs of many runs: CPU, memory, GPU, power meter and meter recordings.

``path`` is the folder that holds the run folders; ``files`` names the log in each. Schemas are declared,
never inferred. With ``stream`` the same rows arrive as a streaming DataFrame that picks up new files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from herdlens.functions.clock import parse_iso
from herdlens.functions.values import array_mean, nan_to_null
from herdlens.sources.layout import FOLDERS, PARTITIONED, check, placed, run_id

MEMORY_FIELDS = ["total", "available", "used", "percent", "free", "active", "inactive", "buffers", "cached"]
MEMORY_SCHEMA = "timestamp string, " + ", ".join(
    f"{f} {'double' if f == 'percent' else 'bigint'}" for f in MEMORY_FIELDS
)
GPU_FIELDS = ["gpu_usage", "gpu_memor", "gpu_volts", "gpu_tempr"]
GPU_SCHEMA = "timestamp string, " + ", ".join(f"{f} string" for f in GPU_FIELDS)

# Fixed column names and types of the power log: the first five make the narrow layout.
POWER_FIELDS = {
    "Datetime": "string",
    "Time[S]": "double",
    "Volt[V]": "double",
    "Current[A]": "double",
    "Power[W]": "double",
    "Res[Ohm]": "double",
    "G0[mAh]": "bigint",
    "G0[mWh]": "bigint",
    "G1[mAh]": "bigint",
    "G1[mWh]": "bigint",
    "Temp[C]": "bigint",
    "D+[V]": "double",
    "D-[V]": "double",
}
# Quotes inside a field are doubled, as the capture side's CSV writer does.
CSV_OPTIONS = {"header": True, "escape": '"'}

RECORDING_FIELDS = {"Rec": "bigint", "Volt[V]": "double", "Current[A]": "double"}


def _schema(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def _reader(spark: SparkSession, stream: bool) -> DataFrameReader | DataStreamReader:
    return spark.readStream if stream else spark.read


def _scan(spark: SparkSession, path: str, schema: str, layout: str, stream: bool, files: str) -> DataFrame:
    """CSV with header. Numbers are padded with blanks in some logs and would read as NULL unstripped."""
    declared = f"{schema}, pid string" if check(layout) == PARTITIONED else schema
    reader = placed(_reader(spark, stream), layout, files).schema(declared)
    return reader.options(**CSV_OPTIONS, ignoreLeadingWhiteSpace=True).csv(path)


def _clean(df: DataFrame) -> dict[str, Column]:
    return {name: nan_to_null(F.col(f"`{name}`")) for name, kind in df.dtypes if kind == "double"}


def read_cpu(
    spark: SparkSession, path: str, layout: str = FOLDERS, stream: bool = False, files: str = "cpu.csv"
) -> DataFrame:
    """``pid, timestamp, cores array<double>, cpu_mean``.

    Machines differ in core count, so a line is read as text and its tail becomes an array: one scan
    serves files of any width, and no header has to be looked at first.
    """
    reader = placed(_reader(spark, stream), layout, files)
    lines = (reader.schema("value string, pid string") if check(layout) == PARTITIONED else reader).text(path)
    fields = F.split("value", ",")
    cores = F.transform(
        F.slice(fields, F.lit(2), F.size(fields) - 1), lambda x: nan_to_null(F.trim(x).try_cast("double"))
    )
    data = (F.length("value") > 0) & ~F.startswith("value", F.lit("timestamp,"))
    return lines.where(data).select(
        run_id(layout), parse_iso(F.get(fields, F.lit(0))).alias("timestamp"), cores.alias("cores")
    ).withColumn("cpu_mean", array_mean(F.col("cores")))


def core_columns(cpu: DataFrame, cores: int) -> DataFrame:
    """The core array as ``cpu_core_0 ... cpu_core_{n-1}``; NULL beyond a machine's own count."""
    wide = [F.get("cores", F.lit(i)).alias(f"cpu_core_{i}") for i in range(cores)]
    return cpu.select("pid", "timestamp", *wide, "cpu_mean")


def read_memory(
    spark: SparkSession, path: str, layout: str = FOLDERS, stream: bool = False, files: str = "mem.csv"
) -> DataFrame:
    df = _scan(spark, path, MEMORY_SCHEMA, layout, stream, files)
    return df.select(run_id(layout), parse_iso("timestamp").alias("timestamp"), *MEMORY_FIELDS).withColumn(
        "percent", nan_to_null("percent")
    )


def read_gpu(
    spark: SparkSession, path: str, layout: str = FOLDERS, stream: bool = False, files: str = "gpu.csv"
) -> DataFrame:
    """Readings stay text, as the tool printed them, without the blanks around."""
    df = _scan(spark, path, GPU_SCHEMA, layout, stream, files)
    return df.select(
        run_id(layout), parse_iso("timestamp").alias("timestamp"), *(F.trim(f).alias(f) for f in GPU_FIELDS)
    )


def read_power(
    spark: SparkSession, path: str, layout: str = FOLDERS, stream: bool = False, files: str = "{single,batch,power}.csv"
) -> DataFrame:
    """Narrow and wide logs alike: the columns a narrow log lacks are NULL. Adds ``timestamp``."""
    df = _scan(spark, path, _schema(POWER_FIELDS), layout, stream, files)
    kept = [F.col(f"`{name}`") for name in POWER_FIELDS if name != "Datetime"]
    rows = df.select(run_id(layout), parse_iso("Datetime").alias("timestamp"), *kept)
    return rows.withColumns(_clean(rows))


def read_recording(
    spark: SparkSession, path: str, layout: str = FOLDERS, stream: bool = False, files: str = "*.csv"
) -> DataFrame:
    df = _scan(spark, path, _schema(RECORDING_FIELDS), layout, stream, files)
    return df.select(run_id(layout), *(F.col(f"`{name}`") for name in RECORDING_FIELDS))
