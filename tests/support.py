"""A local session, and the comparison of a Spark result with an SQL result."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from herdlens.session import configure


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("herdlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def register_tables(con: duckdb.DuckDBPyConnection, folder: str) -> None:
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}'")


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime"):
            out[c] = out[c].astype("datetime64[us]").astype("int64")
    return out.sort_values(list(out.columns), ignore_index=True)


def _kind(values: pd.Series) -> str:
    """Numbers are one kind: pandas turns integers with missing values into floats."""
    return "number" if values.dtype.kind in "iuf" else values.dtype.kind


def mismatch(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs, or None: columns, row count, types up to width, exact values in any order."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if got.empty:
        return "both empty"
    a, b = _plain(got), _plain(want)
    for c in a.columns:
        if _kind(a[c]) != _kind(b[c]) and not a[c].isna().all():
            return f"{c}: type {a[c].dtype} != {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = same.idxmin()
            return f"{c}: {(~same).sum()} rows, e.g. {a.loc[at].to_dict()} != {b.loc[at].to_dict()}"
    return None
