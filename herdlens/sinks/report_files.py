"""Run reports as the capture side leaves them: one indented document a run, ``<run id>/metrics.json``.

A run is never one row: every image is a piece of text that follows the one before in its file. A file is written by one
task, so a long run has several: ``metrics.json`` with its part 0, ``part-1/metrics.json`` and so on beside it, each a
document of the run with some of its animals. The readers find them all and give one run.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdlens.functions.clock import format_iso
from herdlens.operators.flatten import ANIMAL_TIMES, COUNTERS, DOCUMENT_ROWS, IMAGE_TIMES, RUN_TIMES, with_parts
from herdlens.operators.grouped import join_groups

NAME = "metrics.json"
_STEP = "    "


def _quoted(text: Column) -> Column:
    """JSON text of a string, ``null`` without one."""
    inside = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(inside, F.lit(6), F.length(inside) - 6))


def _fields(depth: int, given: dict[str, Column]) -> Column:
    """Lines of an object's fields, without a comma after the last."""
    lines = [F.concat(F.lit(f'{_STEP * depth}"{name}": '), value) for name, value in given.items()]
    return reduce(lambda a, b: F.concat(a, F.lit(",\n"), b), lines)


def document_lines(rows: DataFrame, animals: DataFrame | None = None, rows_per_document: int = DOCUMENT_ROWS) -> DataFrame:
    """``pid, part, value``: the pieces of each document, in the order of its file within sorted partitions.

    Fields are merged as ``flatten.nest_reports`` merges them: of repeated rows of an image the one predicted last stays;
    ``animals`` adds animals that have no image. A run of more than ``rows_per_document`` rows is cut into parts.
    """
    columns = [*RUN_TIMES, *ANIMAL_TIMES, "display_time", *COUNTERS]
    every = rows.select("pid", "animal", "img", *columns, *IMAGE_TIMES)
    if animals is not None:
        missing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("img", *IMAGE_TIMES)]
        every = every.unionByName(animals.select("pid", "animal", *columns, *missing))
    latest = F.max(F.struct("weight_prediction_final", "weight_prediction_start")).alias("times")
    images = every.groupBy("pid", "animal", "img").agg(latest)
    last = ["display_time", "last_image_capture_time", *COUNTERS]
    per_animal = every.groupBy("pid", "animal").agg(*(F.max(c).alias(c) for c in last), F.min("first_image_capture_time").alias("first_image_capture_time"), F.max("img").isNull().alias("bare"))
    per_run = every.groupBy("pid").agg(*(F.min(c).alias(c) for c in RUN_TIMES))
    # The row without an image stands for its animal only if there is no other.
    placed = join_groups(images, per_animal, ["pid", "animal"]).where("img IS NOT NULL OR bare")
    file = ["pid", "part"]
    placed = with_parts(join_groups(placed, per_run, ["pid"]), every, rows_per_document)
    placed = placed.withColumns({"cut": F.col("part").isNotNull(), "part": F.coalesce("part", F.lit(0))}).repartition(*file)
    run, animal = Window.partitionBy(*file).orderBy("animal", "img"), Window.partitionBy(*file, "animal").orderBy("img")
    opens_run, opens = F.row_number().over(run) == 1, F.row_number().over(animal) == 1
    closes_run, closes = F.lead(F.lit(1)).over(run).isNull(), F.lead(F.lit(1)).over(animal).isNull()
    marked = placed.withColumns({"opens_run": opens_run, "closes_run": closes_run, "opens": opens, "closes": closes})
    number = F.when(F.col("cut"), F.concat(F.lit(f'{_STEP}"part": '), F.col("part").cast("string"), F.lit(",\n"))).otherwise(F.lit(""))
    header = F.concat(F.lit("{\n"), F.lit(f'{_STEP}"pid": '), _quoted(F.col("pid")), F.lit(",\n"), number, _fields(1, {c: _quoted(format_iso(c)) for c in RUN_TIMES}), F.lit(f',\n{_STEP}"animals": {{\n'))
    given = {c: _quoted(format_iso(c)) for c in ANIMAL_TIMES} | {"weight_prediction_final": _quoted(format_iso("display_time"))}
    given |= {c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in COUNTERS}
    start = F.concat(F.lit(_STEP * 2 + '"'), F.col("animal").cast("string"), F.lit('": {\n'), _fields(3, given), F.lit(f',\n{_STEP * 3}"imgs": {{'))
    image = F.concat(
        F.when(F.col("opens"), F.lit("\n")).otherwise(F.lit("")), F.lit(_STEP * 4 + '"'), F.col("img").cast("string"), F.lit('": {\n'),
        _fields(5, {c: _quoted(format_iso(F.col("times")[c])) for c in IMAGE_TIMES}), F.lit(f"\n{_STEP * 4}}}"),
    )
    ends = F.concat(F.when(F.col("img").isNull(), F.lit("}")).otherwise(F.lit(f"\n{_STEP * 3}}}")), F.lit(f"\n{_STEP * 2}}}"))
    value = F.concat(
        F.when(F.col("opens_run"), header).otherwise(F.lit("")),
        F.when(F.col("opens"), start).otherwise(F.lit("")),
        F.coalesce(image, F.lit("")),
        F.when(F.col("closes"), ends).otherwise(F.lit("")),
        F.when(F.col("closes_run"), F.lit(f"\n{_STEP}}}\n}}")).otherwise(F.lit(",")),
    )
    # A line separator follows each piece.
    return marked.sortWithinPartitions(*file, "animal", "img").select(*file, value.alias("value"))


def write_report_files(rows: DataFrame, path: str, animals: DataFrame | None = None, rows_per_document: int = DOCUMENT_ROWS) -> None:
    """``<run id>/metrics.json`` under ``path`` for each run of flat image rows; a slash in a run id stays escaped.

    A run of more than ``rows_per_document`` rows has further documents in folders ``part-<number>`` beside it. The files
    appear when all of them are whole: they are written beside their place and moved by name. A run that has
    a file already keeps it and makes the call fail.
    """
    spark = rows.sparkSession
    work = f"{path}/_writing"
    document_lines(rows, animals, rows_per_document).write.partitionBy("pid", "part").text(work)
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(work).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in [s.getPath() for s in files.listStatus(place(work))]:
        escaped = folder.getName().removeprefix("pid=")
        if escaped == folder.getName():
            continue  # the mark of an ended job
        name = unquote(escaped)
        target = f"{path}/{escaped if '/' in name else name}"
        parts = {int(s.getPath().getName().removeprefix("part=")): s.getPath() for s in files.listStatus(folder)}
        for number, written in sorted(parts.items()):
            (text,) = [s.getPath() for s in files.listStatus(written)]
            own = f"{target}/part-{number}" if number else target
            files.mkdirs(place(own))
            if not files.rename(text, place(f"{own}/{NAME}")):
                raise FileExistsError(f"{own}/{NAME}")
    files.delete(place(work), True)
