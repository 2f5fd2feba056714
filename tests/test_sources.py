"""Scans and sinks on small literal files."""

from __future__ import annotations

import csv
import json
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from herdlens.operators.flatten import compat_last_image, explode_animals, flatten_reports, nest_reports
from herdlens.plans.metrics import animal_metrics, run_metrics
from herdlens.sinks.reports import write_reports
from herdlens.sinks.telemetry import write_power, write_telemetry
from herdlens.sources import meter, telemetry
from herdlens.sources.frames import list_images, read_frames, tune_for_frames
from herdlens.sources.layout import PARTITIONED
from herdlens.sources.reports import REPORT_SCHEMA, read_reports

WIDE = """Datetime,Time[S],Volt[V],Current[A],Power[W],Res[Ohm],G0[mAh],G0[mWh],G1[mAh],G1[mWh],Temp[C],D+[V],D-[V]
2026-04-16T20:58:10.123456,  0.0,05.1234,0.12345,00.6325,41.50,    10,    20,    30,    40,+25,0.60,0.61
2026-04-16T20:58:11,  1.0,05.1234,0.12345,00.6325,41.50,    10,    20,    30,    40, -5,0.60,0.61
"""
NARROW = """Datetime,Time[S],Volt[V],Current[A],Power[W]
2026-04-16T20:58:10,  0.0,05.0000,0.10000,00.5000
"""


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_power_logs_wide_and_narrow(spark, tmp_path):
    _write(tmp_path / "single_2026-04-16T20:57:54.289715" / "power.csv", WIDE)
    _write(tmp_path / "a+b c" / "power.csv", NARROW)
    rows = telemetry.read_power(spark, str(tmp_path)).orderBy("pid", "timestamp").collect()
    assert [r.pid for r in rows] == ["a+b c"] + ["single_2026-04-16T20:57:54.289715"] * 2
    assert rows[0]["Power[W]"] == 0.5 and rows[0]["Res[Ohm]"] is None
    assert rows[1]["timestamp"] == datetime(2026, 4, 16, 20, 58, 10, 123456)
    assert rows[2]["timestamp"] == datetime(2026, 4, 16, 20, 58, 11)
    assert [r["Temp[C]"] for r in rows[1:]] == [25, -5]
    assert rows[1]["Time[S]"] == 0.0 and rows[1]["G0[mWh]"] == 20 and rows[1]["D-[V]"] == 0.61


def test_cpu_logs_of_different_width(spark, tmp_path):
    _write(tmp_path / "r1" / "cpu.csv", "timestamp,cpu_core_0,cpu_core_1\n2026-01-01T00:00:00,1.0,3.0\n2026-01-01T00:00:01.5,nan,5.0\n")
    _write(tmp_path / "r2" / "cpu.csv", "timestamp,cpu_core_0,cpu_core_1,cpu_core_2\n2026-01-01T00:00:00,1.0,,4.0\n\n")
    cpu = telemetry.read_cpu(spark, str(tmp_path))
    rows = cpu.orderBy("pid", "timestamp").collect()
    assert [(r.pid, r.cores, r.cpu_mean) for r in rows] == [
        ("r1", [1.0, 3.0], 2.0),
        ("r1", [None, 5.0], 5.0),
        ("r2", [1.0, None, 4.0], 2.5),
    ]
    wide = telemetry.core_columns(cpu, 3).where("pid = 'r1'").orderBy("timestamp").first()
    assert (wide.cpu_core_0, wide.cpu_core_1, wide.cpu_core_2) == (1.0, 3.0, None)


def test_memory_and_gpu_logs(spark, tmp_path):
    _write(
        tmp_path / "r1" / "mem.csv",
        "timestamp,total,available,used,percent,free,active,inactive,buffers,cached\n"
        "2026-01-01T00:00:00,8000000000,4000000000,3,50.5,5,6,7,8,9\n2026-01-01T00:00:01,1,2,3,NaN,5,6,7,8,9\n",
    )
    (tmp_path / "r1").mkdir(exist_ok=True)
    with open(tmp_path / "r1" / "gpu.csv", "w", newline="") as f:
        writer = csv.writer(f)
        writer.writerow(["timestamp", "gpu_usage", "gpu_memor", "gpu_volts", "gpu_tempr"])
        writer.writerow(["2026-01-01T00:00:00", "frequency(46)=0 ", "gpu=8M", 'a "quoted", text', "temp=46.2'C"])
    memory = telemetry.read_memory(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert memory[0].total == 8000000000 and memory[0].percent == 50.5 and memory[1].percent is None
    gpu = telemetry.read_gpu(spark, str(tmp_path)).first()
    assert (gpu.gpu_usage, gpu.gpu_volts, gpu.gpu_tempr) == ("frequency(46)=0", 'a "quoted", text', "temp=46.2'C")


def test_recording_log(spark, tmp_path):
    _write(tmp_path / "r1" / "rec.csv", "Rec,Volt[V],Current[A]\n   1,05.1234,0.12345\n1440,00.0001,1.00000\n")
    rows = telemetry.read_recording(spark, str(tmp_path)).orderBy("Rec").collect()
    assert [tuple(r) for r in rows] == [("r1", 1, 5.1234, 0.12345), ("r1", 1440, 0.0001, 1.0)]


def test_partitioned_logs_keep_their_run_ids(spark, tmp_path):
    cpu = spark.sql("""SELECT pid, timestamp_ntz'2026-01-01 00:00:00' AS timestamp, 1D AS cpu_core_0
                       FROM VALUES ('007'), ('x:y') AS t(pid)""")
    write_telemetry(cpu, f"{tmp_path}/cpu")
    assert {r.pid for r in telemetry.read_cpu(spark, f"{tmp_path}/cpu", PARTITIONED).collect()} == {"007", "x:y"}
    wide = telemetry.read_power(spark, _power_folder(tmp_path))
    write_power(wide, f"{tmp_path}/power")
    back = telemetry.read_power(spark, f"{tmp_path}/power", PARTITIONED)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def _power_folder(tmp_path):
    _write(tmp_path / "logs" / "r1" / "power.csv", WIDE)
    return f"{tmp_path}/logs"


def test_unknown_layout_is_refused(spark):
    with pytest.raises(ValueError, match="layout"):
        telemetry.read_cpu(spark, "anywhere", "flat")


# --- run reports -----------------------------------------------------------------------------------


def _t(second: float) -> str:
    return datetime.fromtimestamp(1_767_225_600 + second).isoformat()


SINGLE = {
    "pid": "single_1:00",
    "load_model_start": _t(0),
    "load_model_final": _t(2.5),
    "animals": {
        "1": {
            "first_image_capture_time": _t(3),
            "imgs": {
                "1": {"weight_prediction_start": _t(3.5), "weight_prediction_final": _t(4)},
                "2": {"weight_prediction_start": _t(5), "weight_prediction_final": _t(5.25)},
                "10": {"weight_prediction_start": _t(6), "weight_prediction_final": _t(6.125)},
            },
            "last_image_capture_time": _t(8),
            "weight_prediction_final": _t(9),
        },
        "2": {"first_image_capture_time": _t(12), "imgs": {}, "last_image_capture_time": None, "weight_prediction_final": _t(13)},
    },
}
BATCH = {
    "pid": "batch_1",
    "load_model_start": _t(0),
    "load_model_final": _t(1),
    "animals": {
        "1": {
            "first_image_capture_time": _t(3),
            "imgs": {"11": {"weight_prediction_start": _t(14), "weight_prediction_final": _t(15)}},
            "total_of_images": 11,
            "suitable_images": 4,
            "last_image_capture_time": _t(13),
            "weight_prediction_final": _t(15.5),
        },
        "10": {
            "first_image_capture_time": _t(18),
            "imgs": {"9": {"weight_prediction_start": _t(28), "weight_prediction_final": _t(30)}},
            "total_of_images": 9,
            "suitable_images": 3,
            "last_image_capture_time": _t(27),
            "weight_prediction_final": _t(31),
        },
    },
}


@pytest.fixture
def reports(spark, tmp_path):
    for report in (SINGLE, BATCH):
        _write(tmp_path / "reports" / report["pid"] / "metrics.json", json.dumps(report, indent=4))
    return read_reports(spark, f"{tmp_path}/reports")


def test_reports_of_both_strategies(reports):
    rows = flatten_reports(reports)
    # Animal 2 of the single run has no images, so it has no row anywhere.
    assert {(r.pid, r.animal, r.img) for r in rows.collect()} == {
        ("single_1:00", 1, 1), ("single_1:00", 1, 2), ("single_1:00", 1, 10), ("batch_1", 1, 11), ("batch_1", 10, 9),
    }
    assert explode_animals(reports).where("last_image_capture_time IS NULL").count() == 1
    animals = {(r.pid, r.animal): r for r in animal_metrics(rows).collect()}
    single = animals["single_1:00", 1]
    assert (single.lead_time_us, single.processing_delay_us, single.latency_us) == (6_000_000, 875_000, 1_000_000)
    assert animals["batch_1", 10].processing_delay_us == 2_000_000
    runs = {r.pid: r for r in run_metrics(animal_metrics(rows)).collect()}
    assert runs["batch_1"].animals == 2 and runs["batch_1"].total_of_images == 20
    assert runs["batch_1"].collect_lead_time_us == 28_000_000
    assert runs["batch_1"].throughput_per_hour == pytest.approx(2 / (28 / 3600))
    assert runs["batch_1"].fps == pytest.approx(20 / 28)
    assert runs["single_1:00"].load_model_dur_us == 2_500_000 and runs["single_1:00"].fps is None


def test_last_image_stands_for_all(reports):
    rows = compat_last_image(flatten_reports(reports))
    delays = {(r.pid, r.animal): r.processing_delay_us for r in animal_metrics(rows).collect()}
    assert delays == {("single_1:00", 1): 3 * 125_000, ("batch_1", 1): 1_000_000, ("batch_1", 10): 2_000_000}


def test_documents_are_bounded_and_read_back_whole(spark, reports, tmp_path):
    rows = flatten_reports(reports)
    assert nest_reports(rows).count() == 2
    small = nest_reports(rows, animals_per_document=5, images_per_document=4)
    assert small.count() == 4  # single: images 1-3 and 10; batch: animals 1 and 10
    twice = rows.unionByName(rows)
    write_reports(twice, f"{tmp_path}/out", animals_per_document=5, images_per_document=4)
    back = flatten_reports(read_reports(spark, f"{tmp_path}/out", lines=True))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_a_run_is_one_document_with_every_animal(spark, tmp_path):
    base = flatten_reports(
        spark.createDataFrame(
            [("r", "2026-01-01T00:00:00", "2026-01-01T00:00:01", {str(a): ("2026-01-01T00:00:00", None, None, 1, 1, {"1": ("2026-01-01T00:00:02", "2026-01-01T00:00:03")}) for a in range(1, 101)})],
            REPORT_SCHEMA,
        )
    )
    assert nest_reports(base).count() == 1
    one = base.where("animal = 1")
    later = one.withColumn("weight_prediction_start", F.lit("2026-01-01 00:00:01").cast("timestamp_ntz")).withColumn(
        "weight_prediction_final", F.lit("2026-01-01 00:00:09").cast("timestamp_ntz")
    )
    bare = base.where("animal = 2").withColumn("animal", F.lit(777))
    write_reports(one.unionByName(later), f"{tmp_path}/out", animals=bare)
    back = read_reports(spark, f"{tmp_path}/out", lines=True).first()
    assert set(back.animals) == {"1", "777"} and back.animals["777"].imgs == {}
    assert tuple(back.animals["1"].imgs["1"]) == ("2026-01-01T00:00:01.000000", "2026-01-01T00:00:09.000000")


def test_run_without_elapsed_time_has_no_throughput(spark):
    same = "timestamp_ntz'2026-01-01 00:00:00'"
    times = ["first_image_capture_time", "last_image_capture_time", "display_time", "load_model_start", "load_model_final"]
    times += ["weight_prediction_start", "weight_prediction_final"]
    rows = spark.sql(
        f"SELECT 'r' AS pid, 1 AS animal, 1 AS img, 3L AS total_of_images, 1L AS suitable_images, {', '.join(f'{same} AS {t}' for t in times)}"
    )
    run = run_metrics(animal_metrics(rows)).first()
    assert (run.throughput_per_hour, run.fps, run.collect_lead_time_us) == (None, None, 0)


# --- power meter -----------------------------------------------------------------------------------

KEY = bytes(range(100, 132))


def _packet(temperature_sign: int = 0, first: bytes = b"pac1") -> bytes:
    one = struct.pack("<4s4s4s13I", first, b"MTR1", b"1.14", 4_000_000_000, *[0] * 7, 12, 51234, 12345, 6325, 99)
    two = struct.pack("<4s15I", b"pac2", 415, 10, 20, 30, 40, temperature_sign, 25, 60, 61, *[0] * 5, 99)
    return one + two + struct.pack("<4s15I", b"pac3", *[0] * 15)


def _sealed(spark, plain: bytes) -> bytes:
    row = spark.range(1).select(F.aes_encrypt(F.lit(plain), F.lit(KEY), F.lit("ECB"), F.lit("PKCS"))).first()
    return bytes(row[0])[: len(plain)]


def test_packets(spark):
    good, cold = _sealed(spark, _packet()), _sealed(spark, _packet(temperature_sign=1))
    noise = bytes(b ^ 0x5A for b in good)
    rows = [(1, good), (2, cold), (3, good[:191]), (4, noise), (5, _sealed(spark, _packet(first=b"pacX"))), (6, None), (7, b"")]
    decoded = meter.decode_packets(spark.createDataFrame(rows, "id int, packet binary"), F.lit(KEY))
    kept = {r.id: r for r in meter.accepted(decoded).collect()}
    assert set(kept) == {1, 2}
    r = kept[1]
    assert (r.Name, r.Version, r.SN, r.Runs) == ("MTR1", "1.14", 4_000_000_000, 12)
    assert (r.Volt, r.Current, r.Power) == (51234 * 1e-4, 12345 * 1e-5, 6325 * 1e-4)
    assert (r.Resistance, r.G0_mAh, r.G0_mWh, r.G1_mAh, r.G1_mWh) == (41.5, 10, 20, 30, 40)
    assert (r.Temp, r.D_plus, r.D_minus) == (25, 60 * 1e-2, 61 * 1e-2)
    assert kept[2].Temp == -25
    assert {r.id for r in meter.rejected(decoded, "id").collect()} == {3, 4, 5, 6, 7}


def test_recordings(spark):
    pairs = struct.pack("<4I", 51234, 12345, 1, 4_294_967_295)
    rows = [(1, pairs), (2, pairs[:8] + b"\x01\x02"), (3, b""), (4, b"\x01\x02\x03"), (5, None)]
    got = meter.decode_recordings(spark.createDataFrame(rows, "id int, blob binary"))
    assert sorted(map(tuple, got.collect())) == [
        (1, 1, 51234 * 1e-4, 12345 * 1e-5),
        (1, 2, 1e-4, 4_294_967_295 * 1e-5),
        (2, 1, 51234 * 1e-4, 12345 * 1e-5),
    ]


# --- frames ----------------------------------------------------------------------------------------


def test_frame_tables_and_image_files(spark, tmp_path):
    frame = spark.sql("""SELECT 'r' AS pid, 1 AS animal, 1 AS img, timestamp_ntz'2026-01-01 00:00:00' AS ts,
                         1 AS h, 2 AS w, array(1f, 2f) AS pixels""")
    frame.write.parquet(f"{tmp_path}/frames")
    scanned = read_frames(spark, f"{tmp_path}/frames")
    assert scanned.first().pixels == [1.0, 2.0]
    plan = scanned.groupBy("pid").count()._jdf.queryExecution().toString()
    assert "ReadSchema: struct<pid:string>" in plan
    _write(tmp_path / "images" / "r1" / "sample.png", "not really")
    assert list_images(spark, f"{tmp_path}/images").first().length == 10


def test_row_batches_fit_full_size_frames(spark):
    names = ["spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = [spark.conf.get(n) for n in names]
    tune_for_frames(spark, 640 * 480)
    try:
        assert [int(spark.conf.get(n)) for n in names] == [27, 27]
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_large_run_is_written_by_several_tasks(spark, tmp_path):
    """Rebalancing splits the rows of a run that is far larger than a partition should be."""
    hot = F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.lit("cold"))
    rows = spark.range(0, 400_000, 1, 8).select(
        hot.alias("pid"),
        F.timestamp_add("SECOND", "id", F.lit("2026-01-01").cast("timestamp_ntz")).alias("timestamp"),
        F.rand(1).alias("cpu_core_0"),
    )
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        write_telemetry(rows, f"{tmp_path}/cpu")
    finally:
        for name in sizes:
            spark.conf.unset(name)
    files = list((tmp_path / "cpu" / "pid=hot").glob("*.csv"))
    assert len(files) >= 3
    assert telemetry.read_cpu(spark, f"{tmp_path}/cpu", PARTITIONED).groupBy("pid").count().count() == 2
    assert telemetry.read_cpu(spark, f"{tmp_path}/cpu", PARTITIONED).count() == 400_000


# --- rejects ---------------------------------------------------------------------------------------


def test_broken_documents_numbers_and_times_are_returned(spark, tmp_path):
    from herdlens.sources.rejects import rejected_cpu_rows, rejected_reports, rejected_rows, require_clean

    _write(tmp_path / "r:1" / "metrics.json", '{"pid": "r:1", "animals": {}}')
    _write(tmp_path / "r:2" / "metrics.json", '{"pid": "r:2", "animals": {')
    broken = rejected_reports(spark, str(tmp_path))
    assert [r.pid for r in broken.collect()] == ["r:2"]
    with pytest.raises(ValueError, match="broken input"):
        require_clean(broken)
    _write(tmp_path / "r:1" / "power.csv", WIDE)
    _write(tmp_path / "r:2" / "power.csv", NARROW + "2026-04-16T20:58:11,  1.0,05.x,0.1,00.5\nnoon,  2.0,05.0,0.1,00.5\n")
    rows = rejected_rows(spark, str(tmp_path), "power").collect()
    assert sorted((r.pid, r.content[:4]) for r in rows) == [("r:2", "2026"), ("r:2", "noon")]
    _write(tmp_path / "r:1" / "cpu.csv", "timestamp,cpu_core_0\n2026-04-16T20:58:10,1.5\n2026-04-16T20:58:11,oops\n,3\n")
    assert len(rejected_cpu_rows(spark, str(tmp_path)).collect()) == 2
    header = "timestamp,total,available,used,percent,free,active,inactive,buffers,cached\n"
    _write(tmp_path / "r:1" / "mem.csv", header + "2026-04-16T20:58:10,1,2,3,4.5,5,6,7,8,9\n2026-04-16T20:58:10,1,2,three,4.5,5,6,7,8,9\n")
    assert len(rejected_rows(spark, str(tmp_path), "memory").collect()) == 1
    require_clean(rejected_rows(spark, str(tmp_path), "gpu", files="none.csv"))
