"""Where a file's run id comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

FOLDERS = "folders"  # <run id>/<file>, as the capture side leaves them
PARTITIONED = "partitioned"  # pid=<run id>/<file>, as the sinks here write them


def check(layout: str) -> str:
    if layout not in (FOLDERS, PARTITIONED):
        raise ValueError(f"layout must be {FOLDERS!r} or {PARTITIONED!r}, not {layout!r}")
    return layout


def placed(
    reader: DataFrameReader | DataStreamReader, layout: str, files: str
) -> DataFrameReader | DataStreamReader:
    """Looks for ``files`` (a name pattern) in all run folders under the path.

    Run ids hold colons, which a pattern over folders cannot match, so the folders are listed instead.
    """
    if check(layout) == PARTITIONED:
        return reader
    return reader.option("pathGlobFilter", files).option("recursiveFileLookup", True)


def run_id(layout: str) -> Column:
    """The folder that holds the file, or the partition column."""
    if check(layout) == PARTITIONED:
        return F.col("pid")
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    return F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("pid")
