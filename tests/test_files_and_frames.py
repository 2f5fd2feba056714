"""Report files by the run, reports read by the line, packed frames, binned densities."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from herdlens.operators import enhance, flatten, scoring
from herdlens.operators.distribution import density
from herdlens.operators.flatten import FLAT_COLUMNS
from herdlens.sinks.report_files import write_report_files
from herdlens.sources import report_lines
from herdlens.sources.report_lines import read_report_images
from herdlens.sources.reports import read_reports

ROWS = (
    "pid string, load_model_start timestamp_ntz, load_model_final timestamp_ntz, animal int, first_image_capture_time timestamp_ntz,"
    "last_image_capture_time timestamp_ntz, display_time timestamp_ntz, total_of_images bigint, suitable_images bigint, img int,"
    "weight_prediction_start timestamp_ntz, weight_prediction_final timestamp_ntz"
)


def moment(seconds: float):
    return (pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=float(seconds))).to_pydatetime()


def image(pid, animal, img, final=None):
    start = animal * 100 + img
    given = [moment(animal * 100), moment(animal * 100 + 50), moment(animal * 100 + 60), 9, None if animal == 2 else 3]
    return (pid, moment(0), None, animal, *given, img, moment(start + 0.25), moment(start + 1 if final is None else final))


@pytest.fixture(scope="module")
def rows():
    made = [image("2026-01-01T10:00:00", a, i) for a in range(12) for i in range(25)] + [image("b/c %", 1, 0), image('quo"te', 3, 7)]
    return [*made, image("2026-01-01T10:00:00", 0, 0, final=5000), image('quo"te', 10, 7)]


def flat(df):
    return sorted((tuple(r) for r in df.select(*FLAT_COLUMNS).collect()), key=repr)


def test_a_run_is_one_indented_document_in_its_folder(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    bare = df.where("pid = 'quo\"te'").limit(1).withColumn("animal", F.lit(77))
    path = str(tmp_path / "reports")
    write_report_files(df, path, animals=bare)
    written = {p.parent.name: p.read_text() for p in (tmp_path / "reports").glob("*/metrics.json")}
    assert set(written) == {"2026-01-01T10:00:00", "b%2Fc %25", 'quo"te'} and not (tmp_path / "reports" / "_writing").exists()
    documents = {name: json.loads(text) for name, text in written.items()}
    for name, text in written.items():
        assert text == json.dumps(documents[name], indent=4) + "\n" or text.strip() == json.dumps(documents[name], indent=4)
    run = documents["2026-01-01T10:00:00"]
    assert run["pid"] == "2026-01-01T10:00:00" and run["load_model_final"] is None
    assert list(map(int, run["animals"])) == list(range(12)) and list(map(int, run["animals"]["3"]["imgs"])) == list(range(25))
    assert run["animals"]["0"]["imgs"]["0"]["weight_prediction_final"] == "2026-01-01T01:23:20.000000"
    assert run["animals"]["2"]["suitable_images"] is None and run["animals"]["1"]["suitable_images"] == 3
    assert documents['quo"te']["animals"]["77"]["imgs"] == {} and list(documents['quo"te']["animals"]) == ["3", "10", "77"]
    with pytest.raises(Exception):
        write_report_files(df, path)


def test_whole_documents_and_lines_read_alike(spark, rows, tmp_path):
    path = str(tmp_path / "reports")
    write_report_files(spark.createDataFrame(rows, ROWS), path)
    (tmp_path / "reports" / "by_hand").mkdir()
    document = {"pid": "by_hand", "load_model_start": "2026-01-01T00:00:00", "load_model_final": "2026-01-01T00:00:05.5", "animals": {}}
    document["animals"]["5"] = {"imgs": {"1": {"weight_prediction_start": None, "weight_prediction_final": "2026-01-01T00:00:07"}, "0": {}}, "total_of_images": 2}
    document["animals"]["6"] = {"total_of_images": 0, "imgs": {}}
    document["animals"]["7"] = {"total_of_images": 1, "imgs": {"4": {"weight_prediction_start": "2026-01-01T00:00:08", "extra": "a: {"}}}
    (tmp_path / "reports" / "by_hand" / "metrics.json").write_text(json.dumps(document, indent=4))
    want = [r for r in flat(flatten.flatten_reports(read_reports(spark, path))) if not (r[0] == "by_hand" and r[9] == 0)]  # an image without fields has no line
    assert flat(read_report_images(spark, path)) == want and len(want) == 303 + 2


@pytest.mark.parametrize("size", [997, 4096])
def test_lines_of_a_file_that_is_read_in_many_splits(spark, rows, tmp_path, size):
    """Splits end inside animals, images and lines."""
    path = str(tmp_path / "reports")
    write_report_files(spark.createDataFrame(rows, ROWS), path)
    want = flat(flatten.flatten_reports(read_reports(spark, path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_report_images(spark, path)
        assert flat(got) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_long_run_has_several_files_and_reads_as_one(spark, rows, tmp_path):
    path = str(tmp_path / "reports")
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    write_report_files(df, path, rows_per_document=40)
    files = sorted(p for p in (tmp_path / "reports").rglob("metrics.json"))
    long = [p for p in files if "2026-01-01T10:00:00" in str(p)]
    assert len(files) == len(long) + 2 and len(long) > 3 and tmp_path / "reports" / "2026-01-01T10:00:00" / "metrics.json" in long
    found = []
    for p in long:
        document = json.loads(p.read_text())
        assert p.read_text().strip() == json.dumps(document, indent=4) and list(map(int, document["animals"])) == sorted(map(int, document["animals"]))
        assert document["part"] == (int(p.parent.name.removeprefix("part-")) if p.parent.name.startswith("part-") else 0)
        found += [(int(a), int(i)) for a, v in document["animals"].items() for i in v["imgs"]]
    assert sorted(found) == [(a, i) for a in range(12) for i in range(25)]
    want = flat(flatten.flatten_reports(flatten.nest_reports(df)))
    assert flat(flatten.flatten_reports(read_reports(spark, path))) == want == flat(read_report_images(spark, path))


def test_parts_of_a_run_keep_an_animal_whole_unless_it_is_long(spark, rows):
    df = spark.createDataFrame([*rows, *(image("long", 1, i) for i in range(90)), image("long", 2, 0)], ROWS)
    bare = df.where("pid = 'long'").limit(1).withColumn("animal", F.lit(77))
    documents = flatten.nest_reports(df, bare, rows_per_document=30).cache()
    parts = {p: sorted(r.part for r in documents.where(F.col("pid") == p).collect()) for p in ("2026-01-01T10:00:00", "long")}
    assert all(v[0] == 0 and len(set(v)) == len(v) > 3 - (k == "long") for k, v in parts.items())
    assert {r.part for r in documents.where(F.col("pid") == 'quo"te').collect()} == {None}
    pieces = flatten.explode_animals(documents).groupBy("pid", "animal").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("imgs")).alias("imgs")).collect()
    found = {(r.pid, r.animal): (r.n, r.imgs) for r in pieces}
    assert all(found["2026-01-01T10:00:00", a] == (1, 25) for a in range(12)) and found["long", 1] == (3, 90) and found["long", 77] == (1, 0)
    assert flat(flatten.flatten_reports(documents)) == flat(flatten.flatten_reports(flatten.nest_reports(df, bare)))


def test_lines_are_carried_down_without_a_shuffle(spark, rows, tmp_path):
    path = str(tmp_path / "reports")
    write_report_files(spark.createDataFrame(rows, ROWS), path)
    lines = report_lines._lines(spark, path, "metrics.json", 4)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file#" in plan and "block" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_values_of_a_line_are_read_like_json(spark):
    given = {'"a b"': "a b", '"q\\"u\\u00e9"': 'q"ué', '""': "", "12": "12", "-3.5": "-3.5", "true": "true", "null": None, "NaN": None, "007": None, "[1,": None}
    assert report_lines._texts(pa.array(list(given))).to_pylist() == list(given.values())


# --- packed frames ------------------------------------------------------------------------------------

FRAMES = "pid string, animal int, img int, h int, w int, pixels array<float>"


def _model():
    return lambda batch: batch.reshape(len(batch), -1).mean(axis=1)


def test_packed_frames_score_like_floats_in_half_the_bytes(spark, tmp_path):
    draw = np.random.default_rng(6)
    rows = [("r", i % 3, i, 5, 4, draw.integers(0, 65_536, 20).astype(float).tolist()) for i in range(40)] + [("r", 1, 90, 5, 4, None), ("r", 1, 91, 3, 3, [1.0] * 20)]
    frames = spark.createDataFrame(rows, FRAMES)
    packed = enhance.pack_frames(frames)
    assert dict(packed.dtypes)["pixels"] == "binary"
    assert packed.where("img = 0").first().pixels == np.array(rows[0][5], "<u2").tobytes()
    both = [{r.img: r.weight for r in scoring.score_enhanced(f, _model, 1950, (6, 6), 3).collect()} for f in (frames, packed)]
    assert both[0] == both[1] and both[1][90] is None and both[1][91] is None
    both = [{r.img: r.pixels for r in enhance.enhance_frames(f, 1950, (6, 6), 1).collect()} for f in (frames, packed)]
    assert both[0] == both[1]


def test_integer_frames_are_resized_as_parts_of_their_types_maximum(spark):
    frames = spark.createDataFrame([("r", 1, 1, 2, 2, [0.0, 65535.0, 65535.0, 0.0])], FRAMES)
    got = enhance.resize_packed_frames(enhance.pack_frames(frames), (2, 2)).first()
    assert got.pixels == pytest.approx([0, 1, 1, 0]) and (got.h, got.w) == (2, 2)
    small = enhance.pack_frames(spark.createDataFrame([("r", 1, 1, 1, 2, [0.0, 255.0])], FRAMES), "u1")
    assert enhance.resize_packed_frames(small, (1, 2), dtype="u1").first().pixels == pytest.approx([0, 1])


def test_pixels_that_cannot_be_packed_fail(spark):
    for bad in (0.5, -1.0, 70_000.0, float("nan")):
        with pytest.raises(Exception, match="cannot hold"):
            enhance.pack_frames(spark.createDataFrame([("r", 1, 1, 1, 1, [bad])], FRAMES)).collect()


# --- densities ------------------------------------------------------------------------------------------


def test_binned_densities_keep_their_bound(spark):
    draw = np.random.default_rng(8)
    values = {"a": draw.normal(size=4000), "b": np.concatenate([draw.normal(size=500), draw.normal(9, 0.3, 300)]), "flat": np.full(5, 2.0), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [(None, 1.0), (None, 4.0)], "pid string, x double")
    for bins in (64, 512):
        exact = {(r.pid, r.point): r.density for r in density(df, ["pid"], "x", 50).collect()}
        binned = {(r.pid, r.point): r.density for r in density(df, ["pid"], "x", 50, bins=bins).collect()}
        assert set(exact) == set(binned)
        for k, vs in [*values.items(), (None, np.array([1.0, 4.0]))]:
            h, d = vs.std(ddof=1) * len(vs) ** -0.2, (vs.max() - vs.min()) / (bins - 1)
            for point in range(50):
                if k == "flat":
                    assert binned[k, point] is None
                else:
                    assert abs(exact[k, point] - binned[k, point]) <= d * d / (8 * np.sqrt(2 * np.pi) * h**3) + 1e-12
