"""What the readers could not read: broken documents, numbers and times, as rows of run, file and content.

The readers themselves turn a broken field into NULL and a broken document into none; these tables name them, and
``require_clean`` makes a job of them that fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.functions.clock import parse_iso
from herdlens.sources import telemetry
from herdlens.sources.layout import FOLDERS, PARTITIONED, check, placed, run_id
from herdlens.sources.reports import REPORT_SCHEMA

_MEMORY = {"timestamp": "string"} | {f: "double" if f == "percent" else "bigint" for f in telemetry.MEMORY_FIELDS}
_GPU = {"timestamp": "string"} | dict.fromkeys(telemetry.GPU_FIELDS, "string")
#: Per log: its fields in order, the field of the time, and the usual files.
LOGS = {
    "memory": (_MEMORY, "timestamp", "mem.csv"),
    "gpu": (_GPU, "timestamp", "gpu.csv"),
    "power": (telemetry.POWER_FIELDS, "Datetime", "{single,batch,power}.csv"),
    "recording": (telemetry.RECORDING_FIELDS, None, "*.csv"),
}


def rejected_reports(spark: SparkSession, path: str, lines: bool = False, files: str = "metrics.json") -> DataFrame:
    """``pid, file, content`` of documents that are no JSON of the report's shape, or have no ``pid``."""
    reader = spark.read if lines else placed(spark.read, FOLDERS, files)
    declared = f"{REPORT_SCHEMA.strip()}, _broken string"
    read = reader.schema(declared).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_broken").json(path)
    folder = run_id(FOLDERS) if not lines else F.lit(None).cast("string").alias("pid")
    kept = read.select(folder, F.col("_metadata.file_path").alias("file"), F.col("_broken").alias("content"), F.col("pid").alias("__pid"))
    return kept.where("content IS NOT NULL OR __pid IS NULL").drop("__pid")


def _broken_number(text: Column, kind: str) -> Column:
    given = text.isNotNull() & (F.trim(text) != "")
    return F.lit(False) if kind == "string" else F.coalesce(given & F.trim(text).try_cast(kind).isNull(), F.lit(False))


def rejected_rows(spark: SparkSession, path: str, log: str, layout: str = FOLDERS, files: str | None = None) -> DataFrame:
    """``pid, file, content`` of log rows with a number or time that does not parse; missing fields are no fault."""
    fields, time, usual = LOGS[log]
    schema = ", ".join(f"`{name}` string" for name in fields) + (", pid string" if check(layout) == PARTITIONED else "")
    rows = placed(spark.read, layout, files or usual).schema(schema).options(**telemetry.CSV_OPTIONS).csv(path)
    bad = reduce(lambda a, b: a | b, (_broken_number(F.col(f"`{name}`"), kind) for name, kind in fields.items()))
    if time:
        bad = bad | parse_iso(F.trim(f"`{time}`")).isNull()
    content = F.concat_ws(",", *(F.col(f"`{name}`") for name in fields))
    return rows.where(bad).select(run_id(layout), F.col("_metadata.file_path").alias("file"), content.alias("content"))


def rejected_cpu_rows(spark: SparkSession, path: str, layout: str = FOLDERS, files: str = "cpu.csv") -> DataFrame:
    """The same for CPU logs, whose width differs from machine to machine."""
    reader = placed(spark.read, layout, files)
    lines = (reader.schema("value string, pid string") if check(layout) == PARTITIONED else reader).text(path)
    fields = F.split("value", ",")
    cores = F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))
    bad = F.exists(cores, lambda x: _broken_number(x, "double")) | parse_iso(F.get(fields, F.lit(0))).isNull()
    data = (F.length("value") > 0) & ~F.startswith("value", F.lit("timestamp,"))
    return lines.where(data & bad).select(run_id(layout), F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def require_clean(rejects: DataFrame) -> None:
    """Fail, naming a few, if there are rejects."""
    some = rejects.limit(3).collect()
    if some:
        raise ValueError("broken input: " + "; ".join(f"{r.file}: {(r.content or '')[:80]}" for r in some))
