"""A stream over several files gives what the batch form gives over all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from herdlens.operators.energy import energy_by_run
from herdlens.operators.passages import passage_sessions
from herdlens.operators.scoring import mean_weights, score_enhanced
from herdlens.sources import telemetry
from herdlens.streaming import energy, frames, tables
from herdlens.streaming.telemetry import utilisation, utilisation_stream

READINGS = "pid string, timestamp timestamp_ntz, `Power[W]` double"


def _readings(spark, pdf: pd.DataFrame):
    at = F.timestamp_add("SECOND", "t", F.lit("2026-01-01").cast("timestamp_ntz"))
    return spark.createDataFrame(pdf).select("pid", at.alias("timestamp"), F.col("p").alias("Power[W]"))


@pytest.fixture
def readings() -> pd.DataFrame:
    rng = np.random.default_rng(11)
    t = np.sort(rng.choice(20_000, 900, replace=False))
    return pd.DataFrame({"pid": np.where(rng.random(900) < 0.6, "hot", rng.choice(["a", "b", "c"], 900)), "t": t, "p": rng.uniform(0, 9, 900)})


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _write_in_order(df, folder, key, pieces):
    """One file per piece of time, older pieces first."""
    for i, (low, high) in enumerate(zip(pieces, pieces[1:])):
        piece = df.where((F.col(key) >= low) & (F.col(key) < high))
        piece.coalesce(1).write.mode("append").parquet(folder)


def _cuts(*seconds):
    return [(pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=s)).to_pydatetime() for s in seconds]


def test_energy_over_micro_batches(spark, readings, tmp_path):
    df = _readings(spark, readings)
    _write_in_order(df, f"{tmp_path}/in", "timestamp", _cuts(0, 3000, 9000, 9001, 20_001))
    stream = _stream(spark, f"{tmp_path}/in", READINGS)
    energy.integrate_stream(stream, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    got = {r.pid: r.energy_wh for r in energy.stream_energy(spark, f"{tmp_path}/state").collect()}
    want = {r.pid: r.energy_wh for r in energy_by_run(df).collect()}
    assert got == pytest.approx(want, rel=1e-12)


def test_energy_goes_on_after_a_restart_and_leaves_late_readings_out(spark, tmp_path):
    def add(rows):
        _readings(spark, pd.DataFrame(rows, columns=["pid", "t", "p"])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = _stream(spark, f"{tmp_path}/in", READINGS)
        energy.integrate_stream(stream, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
        return {r.pid: r.energy_wh for r in energy.stream_energy(spark, f"{tmp_path}/state").collect()}

    assert add([("a", 0, 10.0), ("a", 3600, 20.0), ("b", 0, 1.0)]) == {"a": 20.0, "b": 0.0}
    assert add([("a", 1800, 999.0), ("a", 7200, 5.0), ("a", 3600, 7.0)]) == {"a": 25.0, "b": 0.0}
    assert add([("b", 7200, 4.0)]) == {"a": 25.0, "b": 8.0}


def test_repeated_micro_batch_counts_once(spark, tmp_path):
    rows = pd.DataFrame([("a", 0, 1.0), ("a", 3600, 2.0)], columns=["pid", "t", "p"])
    _readings(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")  # one file, so one micro-batch
    for check in ("first", "again"):  # a lost checkpoint replays batch 0 over the same state table
        stream = _stream(spark, f"{tmp_path}/in", READINGS)
        energy.integrate_stream(stream, f"{tmp_path}/state", f"{tmp_path}/{check}").awaitTermination()
    assert energy.stream_energy(spark, f"{tmp_path}/state").first().energy_wh == 2.0


def test_utilisation_windows(spark, readings, tmp_path):
    df = _readings(spark, readings)
    _write_in_order(df, f"{tmp_path}/in", "timestamp", _cuts(0, 7000, 15_000, 20_001))
    windows = utilisation_stream(_stream(spark, f"{tmp_path}/in", READINGS), "Power[W]", "10 minutes", "5 minutes", "pid")
    tables.append_table(windows, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    done = F.lit((pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=int(readings.t.max()) - 300 - 600)).to_pydatetime()).cast("timestamp_ntz")
    want = utilisation(df, "Power[W]", "10 minutes", "pid").where(F.col("window_start") <= done)
    columns = ["pid", "window_start", "readings", F.round("mean", 9)]
    got = spark.read.parquet(f"{tmp_path}/out").select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_logs_as_a_stream(spark, tmp_path):
    for run, value in (("r:1", 2.0), ("r:2", 4.0)):
        (tmp_path / "reports" / run).mkdir(parents=True)
        (tmp_path / "reports" / run / "cpu.csv").write_text(f"timestamp,cpu_core_0,cpu_core_1\n2026-01-01T00:00:00,{value},{value}\n")
    cpu = telemetry.read_cpu(spark, f"{tmp_path}/reports", stream=True).select("pid", "timestamp", "cpu_mean")
    tables.append_table(cpu, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted((r.pid, r.cpu_mean) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("r:1", 2.0), ("r:2", 4.0)]


FRAMES = "pid string, animal int, img int, ts timestamp_ntz, elapsed double, weight double, h int, w int, pixels array<float>"


@pytest.fixture
def frame_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for animal in range(6):
        start = animal * 60
        for img, second in enumerate(np.sort(rng.choice(12, 7, replace=False))):
            at = (pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=int(start + second))).to_pydatetime()
            pixels = rng.uniform(0, 3000, 6).astype(np.float32).tolist()
            rows.append(("r", animal, img, at, float(second), float(rng.uniform(20, 90)), 2, 3, pixels))
    return spark.createDataFrame(rows, FRAMES)


def _model():
    return lambda batch: batch.reshape(len(batch), -1).mean(axis=1)


def test_running_weights(spark, frame_rows, tmp_path):
    _write_in_order(frame_rows, f"{tmp_path}/in", "ts", _cuts(0, 65, 130, 400))
    means = frames.running_weights(_stream(spark, f"{tmp_path}/in", FRAMES), _model, 10, 6, (4, 4), 1950, 3)
    tables.change_table(means, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = tables.latest(spark, f"{tmp_path}/out", ["pid", "animal"])
    chosen = frame_rows.where("elapsed < 10 AND elapsed <= 6")
    want = mean_weights(score_enhanced(chosen, _model, 1950, (4, 4), 3))
    columns = ["animal", "scored_images", F.round("mean_weight", 6)]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_passages_are_emitted_once_they_are_over(spark, frame_rows, tmp_path):
    _write_in_order(frame_rows, f"{tmp_path}/in", "ts", _cuts(0, 65, 130, 400))
    over = frames.passage_weights(_stream(spark, f"{tmp_path}/in", FRAMES), ["pid", "animal"], 12, "5 seconds", 6)
    tables.append_table(over, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("animal").collect()
    want = passage_sessions(frame_rows, ["pid", "animal"], 12).orderBy("animal").collect()
    # The last animal's passage is still open.
    assert [(r.animal, r.session_start, r.total_of_images) for r in got] == [
        (r.animal, r.session_start, r.frames) for r in want[:-1]
    ]
    suitable = frame_rows.where("elapsed <= 6").groupBy("animal").agg(F.count("*").alias("n"), F.avg("weight").alias("m"))
    means = {r.animal: (r.n, round(r.m, 9)) for r in suitable.collect()}
    assert all((r.suitable_images, r.mean_weight and round(r.mean_weight, 9)) == means.get(r.animal, (0, None)) for r in got)


def test_energy_state_keeps_few_versions(spark, tmp_path):
    """However many micro-batches there were, only the last versions of the state are kept and read."""
    schema = "pid string, timestamp timestamp_ntz, `Power[W]` double"
    source, out = str(tmp_path / "in"), str(tmp_path / "state")
    for i in range(7):
        rows = spark.sql(f"SELECT 'r' AS pid, timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, {i}, 0, 0) AS timestamp, 10.0D AS `Power[W]`")
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        energy.integrate_stream(stream, out, str(tmp_path / "check")).awaitTermination()
    versions = [p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("batch=")]
    assert sorted(versions) == ["batch=4", "batch=5", "batch=6"]
    assert energy.stream_energy(spark, out).first().energy_wh == pytest.approx(60.0)


def test_running_weights_of_past_periods_leave_the_state(spark, frame_rows, tmp_path):
    _write_in_order(frame_rows, f"{tmp_path}/in", "ts", _cuts(0, 65, 130, 200, 260, 400))
    stream = _stream(spark, f"{tmp_path}/in", FRAMES)
    means = frames.running_weights(stream, _model, 10, 6, (4, 4), 1950, 3, period="1 minute", delay="1 second")
    query = tables.change_table(means, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    got = tables.latest(spark, f"{tmp_path}/out", ["pid", "animal", "period_start"])
    chosen = frame_rows.where("elapsed < 10 AND elapsed <= 6")
    want = mean_weights(score_enhanced(chosen, _model, 1950, (4, 4), 3))
    columns = ["animal", "scored_images", F.round("mean_weight", 6)]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2 < want.count()


def test_passages_from_raw_frames_to_the_end(spark, frame_rows, tmp_path):
    raw = frame_rows.drop("weight")
    schema = FRAMES.replace("weight double, ", "")
    _write_in_order(raw, f"{tmp_path}/in", "ts", _cuts(0, 65, 130, 400))
    stream, ends = _stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/ends"
    over = frames.passage_scores(tables.closable(stream, ends), ["pid", "animal"], 12, "5 seconds", _model, 10, 6, (4, 4), 1950, 3)
    tables.append_table(over, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    tables.write_end(stream, ends, "ts", elapsed=0.0)
    tables.append_table(over, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    within = raw.where("elapsed < 10")
    chosen = within.where("elapsed <= 6")
    means = {r.animal: (r.scored_images, round(r.mean_weight, 6)) for r in mean_weights(score_enhanced(chosen, _model, 1950, (4, 4), 3)).collect()}
    counts = {r.animal: r["count"] for r in within.groupBy("animal").count().collect()}
    got = {r.animal: (r.total_of_images, r.suitable_images, r.mean_weight and round(r.mean_weight, 6)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {a: (n, *means.get(a, (0, None))) for a, n in counts.items()}
