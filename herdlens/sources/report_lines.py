"""Large run reports read by the line: image rows without a document in memory.

The capture side writes a report with one field a line, indented by its depth. So a line tells by itself what it is, and
what it belongs to is the nearest header above: the animal two levels deep, the image four. Files are read in
splits like any text; headers are carried down as the lines of a split pass by, a batch at a time, and each split hands
its last headers on to those that follow it in its file, one row each. Lines are not sorted or shuffled before they are
merged into images, and nothing needs the whole document, nor the whole file or split in a task.

For documents written in another way use ``reports.read_reports``, which parses a document as one row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from herdlens.functions.clock import parse_iso
from herdlens.operators.flatten import ANIMAL_TIMES, COUNTERS, FLAT_COLUMNS, IMAGE_TIMES, RUN_TIMES
from herdlens.operators.grouped import join_groups
from herdlens.sources.layout import FOLDERS, placed

# Depth of a line, key, and what follows the key without the comma behind it.
_LINE = r'^(?P<pad>\s*)"(?P<key>(?:[^"\\]|\\.)*)"\s*:\s*(?P<rest>.*?),?\s*$'
_SPLIT = ["file", "block"]
_HEADS = {"animal": 2, "img": 4}
_FIELDS = "file string, block bigint, depth int, key string, text string, animal string, img string"


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def _scalar(rest: str) -> str | None:
    """The text of a JSON value on one line; NULL for null and for what does not parse."""
    try:
        value = json.loads(rest, parse_constant=_refuse)
    except ValueError:
        return None
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) else None if value is None else rest


def _texts(rest: pa.Array) -> pa.Array:
    plain = pc.match_substring_regex(rest, r'^(?:"[^"\\]*"|-?(?:0|[1-9]\d*))$')
    other = pc.invert(plain)
    texts = pc.utf8_trim(rest, '"')
    return pc.replace_with_mask(texts, other, pa.array([_scalar(r) for r in rest.filter(other).to_pylist()], pa.string()))


def _parsed(batch: pa.RecordBatch, indent: int) -> list[pa.RecordBatch]:
    """Lines that hold a field or open an object, by split."""
    found = pc.extract_regex(batch.column("value"), pattern=_LINE)
    kept = pc.is_valid(found)
    if not pc.any(kept).as_py():
        return []
    pad, key, rest = (pc.struct_field(found.filter(kept), n) for n in ("pad", "key", "rest"))
    field = pc.invert(pc.starts_with(rest, "{"))
    columns = {n: batch.column(n).filter(kept) for n in _SPLIT}
    columns["depth"] = pc.divide(pc.utf8_length(pad), pa.scalar(indent, pa.int32()))
    columns["key"] = key
    columns["text"] = pc.replace_with_mask(pa.nulls(len(rest), pa.string()), field, _texts(rest.filter(field)))
    lines = pa.RecordBatch.from_pydict(columns)
    same = [pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (columns[n] for n in _SPLIT)]
    cuts = [0, *(np.flatnonzero(~(same[0] & same[1])) + 1).tolist(), len(rest)]
    return [lines.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _carry(indent: int, edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fields with the headers above them in their split, or the last headers of each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, heads = None, dict.fromkeys(_HEADS)

        def edge() -> list[pa.RecordBatch]:
            given = {**dict(zip(_SPLIT, split, strict=True)), **heads} if edges and split else {}
            return [pa.RecordBatch.from_pydict({n: pa.array([v], pa.int64() if n == "block" else pa.string()) for n, v in given.items()})] if given else []

        for lines in (part for batch in batches for part in _parsed(batch, indent)):
            own = tuple(lines.column(n)[0].as_py() for n in _SPLIT)
            if own != split:
                yield from edge()
                split, heads = own, dict.fromkeys(_HEADS)
            carried, depth, key = {}, lines.column("depth").to_numpy(), lines.column("key")
            for name, level in _HEADS.items():
                last = np.maximum.accumulate(np.where(depth == level, np.arange(len(depth)), -1))
                above = key.take(pa.array(last, mask=last < 0))
                carried[name] = above if heads[name] is None else pc.fill_null(above, heads[name])
                heads[name] = carried[name][-1].as_py()
            if not edges:
                every = pa.RecordBatch.from_pydict({**dict(zip(lines.schema.names, lines.columns, strict=True)), **carried})
                yield every.filter(pc.is_in(lines.column("depth"), pa.array([1, 3, 5], pa.int32())))
        yield from edge()

    return run


def _lines(spark: SparkSession, path: str, files: str, indent: int) -> DataFrame:
    """Lines that hold a field: file, depth, key, text, and the ``animal`` and ``img`` that they belong to."""
    text = placed(spark.read, FOLDERS, files).text(path)
    raw = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    edges = raw.mapInArrow(_carry(indent, True), "file string, block bigint, animal string, img string")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = edges.select(*_SPLIT, *(F.last(c, ignorenulls=True).over(before).alias(f"before_{c}") for c in _HEADS))
    # One row for each split: small beside the lines, which need no shuffle then.
    return raw.mapInArrow(_carry(indent, False), _FIELDS).join(F.broadcast(earlier), _SPLIT).select(
        "file", "depth", "key", "text", *(F.coalesce(c, f"before_{c}").alias(c) for c in _HEADS)
    )


def _field(name: str, value: Column | None = None) -> Column:
    """The field of a name; times and numbers are converted line by line, as they merge in place where texts would be sorted."""
    return F.max(F.when(F.col("key") == name, F.col("text") if value is None else value)).alias(name)


def read_report_images(spark: SparkSession, path: str, files: str = "metrics.json", indent: int = 4) -> DataFrame:
    """Flat image rows of the indented documents under ``path``, one in each run folder; an animal without images has none."""
    lines = _lines(spark, path, files, indent)
    time, number = parse_iso("text"), F.col("text").cast("bigint")
    runs = lines.where("depth = 1").groupBy("file").agg(_field("pid"), *(_field(c, time) for c in RUN_TIMES))
    named = [_field(c, time) for c in ANIMAL_TIMES] + [_field("weight_prediction_final", time).alias("display_time")]
    animals = lines.where("depth = 3").groupBy("file", "animal").agg(*named, *(_field(c, number) for c in COUNTERS))
    images = lines.where("depth = 5").groupBy("file", "animal", "img").agg(*(_field(c, time) for c in IMAGE_TIMES))
    rows = join_groups(join_groups(images, animals, ["file", "animal"]), runs, ["file"])
    return rows.withColumns({c: F.col(c).cast("int") for c in ("animal", "img")}).select(*FLAT_COLUMNS)
