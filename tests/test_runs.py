"""Streams by the time of each run: runs out of order, raw frames, late readings, and result tables of bounded size."""

from __future__ import annotations

import glob

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from herdlens.operators.energy import energy_by_run
from herdlens.operators.passages import passage_sessions
from herdlens.operators.scoring import mean_weights, score_enhanced
from herdlens.operators.selection import frame_counters, suitable_frames, with_elapsed
from herdlens.streaming import late_energy, runs, tables
from herdlens.streaming.telemetry import utilisation

READINGS = "pid string, timestamp timestamp_ntz, `Power[W]` double"
FRAMES = "pid string, animal int, img int, ts timestamp_ntz, weight double, elapsed double, h int, w int, pixels array<float>"
YEAR = 365 * 86_400


def at(seconds: float):
    return (pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=float(seconds))).to_pydatetime()


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def files(spark, schema, folder, *parts):
    """One file per part, in this order, so each is a micro-batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def same(got, want, *columns):
    pick = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert pick(got) == pick(want)


@pytest.fixture(scope="module")
def readings():
    draw = np.random.default_rng(5)
    rows = lambda pid, start: [(pid, at(start + t), float(p)) for t, p in zip(np.sort(draw.choice(20_000, 300, replace=False)), draw.uniform(0, 9, 300), strict=True)]
    return rows("new", YEAR), rows("old", 0)


def test_a_run_a_year_older_that_comes_second_loses_no_window(spark, readings, tmp_path):
    new, old = readings
    files(spark, READINGS, f"{tmp_path}/in", new[:150], old[:200], new[150:] + [("new", at(YEAR), None)], old[200:])
    source = tables.closable(stream(spark, f"{tmp_path}/in", READINGS), f"{tmp_path}/ends")
    windows = runs.utilisation_by_run(source, "Power[W]", "10 minutes", "5 minutes")
    runs.run_table(windows, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    batch = spark.createDataFrame(new + old, READINGS)
    tables.write_ends(batch, f"{tmp_path}/ends", ["pid"], "timestamp")
    runs.run_table(windows, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    same(out.where("NOT late"), utilisation(batch, "Power[W]", "10 minutes", "pid"), "pid", "window_start", "readings", F.round("mean", 9))
    # A missing reading long after its window was final is told, not lost.
    assert [(r.pid, r.readings, r["mean"]) for r in out.where("late").collect()] == [("new", 0, None)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def frame_rows(seed=4):
    draw = np.random.default_rng(seed)
    out = []
    for pid, start in (("new", YEAR), ("old", 0)):
        for animal in range(4):
            for img, second in enumerate(np.sort(draw.choice(30, 9, replace=False))):
                pixels = draw.uniform(0, 3000, 6).astype(np.float32).tolist()
                out.append((pid, animal, img, at(start + animal * 100 + int(second)), float(draw.uniform(20, 90)), float(second), 2, 3, pixels))
    return out


def _model():
    return lambda batch: batch.reshape(len(batch), -1).mean(axis=1)


def test_passages_of_an_older_run_that_comes_second(spark, tmp_path):
    rows = frame_rows()
    new, old = [r for r in rows if r[0] == "new"], [r for r in rows if r[0] == "old"]
    files(spark, FRAMES, f"{tmp_path}/in", new[:20], old[:10], new[20:], old[10:])
    source = tables.closable(stream(spark, f"{tmp_path}/in", FRAMES), f"{tmp_path}/ends")
    over = runs.passages_by_run(source, 8, "3 seconds", 100.0)
    runs.run_table(over, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    batch = spark.createDataFrame(rows, FRAMES)
    tables.write_ends(batch, f"{tmp_path}/ends", ["pid", "animal"], "ts")
    runs.run_table(over, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.where("late").isEmpty()
    got = out.select("pid", "animal", "session_start", F.col("total_of_images").alias("frames"), F.round("mean_weight", 9).alias("m"))
    want = passage_sessions(batch, ["pid", "animal"], 8).select("pid", "animal", "session_start", "frames", F.round("mean_weight", 9).alias("m"))
    same(got, want, "pid", "animal", "session_start", "frames", "m")


@pytest.mark.parametrize("order", ["by time", "mixed within the delay"])
def test_raw_frames_to_scored_passages(spark, tmp_path, order):
    rows = frame_rows()
    if order != "by time":  # neighbours change places across files
        draw = np.random.default_rng(1)
        rows = [rows[i] for i in np.argsort(np.arange(len(rows)) + draw.uniform(0, 2.5, len(rows)), kind="stable")]
    new, old = [r for r in rows if r[0] == "new"], [r for r in rows if r[0] == "old"]
    files(spark, FRAMES, f"{tmp_path}/in", new[:5], new[5:23], old[:9], new[23:], old[9:])
    raw = stream(spark, f"{tmp_path}/in", FRAMES).drop("elapsed", "weight")
    source = tables.closable(raw, f"{tmp_path}/ends")
    scored = runs.scored_passages(source, _model, 20, 12, "15 seconds", 1950, (4, 4), 3)
    runs.run_table(scored, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    batch = spark.createDataFrame(rows, FRAMES).drop("elapsed", "weight")
    tables.write_ends(batch, f"{tmp_path}/ends", ["pid", "animal"], "ts")
    runs.run_table(scored, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.where("late").isEmpty()
    timed = with_elapsed(batch)
    chosen = suitable_frames(timed, 20, 12)
    same(out.where("elapsed IS NOT NULL"), chosen, "pid", "animal", "img", "ts", "elapsed")
    got = runs.passage_results(out)
    want = frame_counters(timed, 20, 12).join(mean_weights(score_enhanced(chosen, _model, 1950, (4, 4), 3)), ["pid", "animal"])
    columns = ["pid", "animal", "total_of_images", "suitable_images", "first_image_capture_time", "last_image_capture_time", "scored_images"]
    same(got, want, *columns, F.round("mean_weight", 5))


def test_frames_that_come_too_late_are_told(spark, tmp_path):
    frame = lambda second, img: ("r", 1, img, at(second), 1.0, 0.0, 2, 3, [1.0] * 6)
    files(spark, FRAMES, f"{tmp_path}/in", [frame(10, 1), frame(14, 2)], [frame(3, 0)], [frame(100, 3)], [frame(12, 4), frame(90, 5)])
    source = stream(spark, f"{tmp_path}/in", FRAMES).drop("elapsed", "weight")
    chosen = runs.selected_frames(source, 20, 12, "2 seconds")
    runs.run_table(chosen, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.img, r.elapsed) for r in out.where("elapsed IS NOT NULL").collect()) == [(1, 0.0), (2, 4.0)]
    assert sorted(r.img for r in out.where("late").collect()) == [0, 4]
    over = out.where("total_of_images IS NOT NULL").collect()
    assert [(r.total_of_images, r.suitable_images, r.first_ts, r.last_ts) for r in over] == [(2, 2, at(10), at(14))]


def test_an_idle_run_ends_by_its_timer(spark, readings, tmp_path):
    new, old = readings
    files(spark, READINGS, f"{tmp_path}/in", old)
    windows = runs.utilisation_by_run(stream(spark, f"{tmp_path}/in", READINGS), "Power[W]", "10 minutes", "5 minutes", idle="1 second")
    with_timers = runs.run_table(windows, f"{tmp_path}/out", f"{tmp_path}/check", trigger="1 second")
    try:
        want = utilisation(spark.createDataFrame(old, READINGS), "Power[W]", "10 minutes", "pid").count()
        for _ in range(60):
            with_timers.awaitTermination(1)
            if spark.read.schema(windows.schema).parquet(f"{tmp_path}/out").count() == want:
                break
        assert spark.read.parquet(f"{tmp_path}/out").count() == want
    finally:
        with_timers.stop()


# --- energy in any order ------------------------------------------------------------------------------


def test_energy_of_shuffled_files_is_the_batch_total(spark, readings, tmp_path):
    new, old = readings
    rows = [*new, *old, ("old", at(50), None), ("one", at(5), 3.0), (None, at(0), 1.0), (None, at(7200), 2.0)]
    pieces = [new[a : a + 60] for a in range(0, 300, 60)] + [old[a : a + 60] for a in range(0, 300, 60)] + [rows[600:]]
    order = np.random.default_rng(2).permutation(len(pieces))
    files(spark, READINGS, f"{tmp_path}/in", *(pieces[i] for i in order))
    late_energy.integrate_any_order(stream(spark, f"{tmp_path}/in", READINGS), f"{tmp_path}/state", f"{tmp_path}/check", "1 day").awaitTermination()
    got = {r.pid: r.energy_wh for r in late_energy.energy_so_far(spark, f"{tmp_path}/state").collect()}
    want = {r.pid: r.energy_wh for r in energy_by_run(spark.createDataFrame(rows, READINGS)).collect()}
    assert got == pytest.approx(want, rel=1e-12) and late_energy.late_readings(spark, f"{tmp_path}/state").isEmpty()
    assert len(glob.glob(f"{tmp_path}/state/batch=*")) == 3


def test_old_readings_find_a_place_beside_pieces_or_go_aside(spark, tmp_path):
    at_hours = lambda *rows: [("a", at(h * 3600), float(p)) for h, p in rows]
    first = at_hours((0.1, 1), (0.3, 2), (5, 3), (9, 4))
    then = at_hours((0.05, 7), (0.2, 100), (0.3, 50), (0.5, 8), (2.5, 5), (2.7, 6))
    files(spark, READINGS, f"{tmp_path}/in", first, then)
    for check in ("first", "again"):  # a lost checkpoint repeats both micro-batches over the same state
        late_energy.integrate_any_order(stream(spark, f"{tmp_path}/in", READINGS), f"{tmp_path}/state", f"{tmp_path}/{check}", "1 hour").awaitTermination()
    late = sorted(r["Power[W]"] for r in late_energy.late_readings(spark, f"{tmp_path}/state").collect())
    assert late == [50.0, 100.0]
    placed = [r for r in first + then if r[2] not in late]
    want = energy_by_run(spark.createDataFrame(placed, READINGS)).first().energy_wh
    assert late_energy.energy_so_far(spark, f"{tmp_path}/state").first().energy_wh == pytest.approx(want, rel=1e-12)


# --- result tables --------------------------------------------------------------------------------------


def test_a_change_table_stays_short(spark, tmp_path):
    path, keys, read = str(tmp_path / "t"), ["k"], []
    for batch in range(60):
        rows = spark.createDataFrame([(batch % 7, batch)], "k int, v int").coalesce(1)
        for _ in range(2 if batch in (9, 10, 19) else 1):  # some micro-batches are repeated
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
            if (batch + 1) % 5 == 0:
                tables.compact(spark, path, keys, batch)
        if batch >= 15:
            read.append(len(tables.latest(spark, path, keys).inputFiles()))
    assert max(read) <= 6 and len(glob.glob(f"{path}/batch=*")) <= 10 and len(glob.glob(f"{path}/_snapshots/upto=*")) == 2
    assert {r.k: r.v for r in tables.latest(spark, path, keys).collect()} == {b % 7: b for b in range(53, 60)}


def test_a_snapshot_that_was_not_finished_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    for batch in range(6):
        spark.createDataFrame([(batch % 2, batch)], "k int, v int").coalesce(1).write.parquet(f"{path}/batch={batch}")
    tables.compact(spark, path, ["k"], 3)
    tables.compact(spark, path, ["k"], 5)
    (tmp_path / "t" / "_snapshots" / "upto=5" / "_SUCCESS").unlink()
    assert {r.k: r.v for r in tables.latest(spark, path, ["k"]).collect()} == {0: 4, 1: 5}


# --- state calls: each crosses to the JVM and back ------------------------------------------------------


class _Counted:
    """A handle whose states count their calls."""

    def __init__(self):
        self.calls = 0

    def getValueState(self, *_):
        return _CountedState(self)

    getListState = getMapState = getValueState


class _CountedState:
    def __init__(self, handle):
        self.handle, self.kept = handle, {}

    def _call(self):
        self.handle.calls += 1

    def exists(self):
        self._call()
        return bool(self.kept)

    def get(self):
        self._call()
        return self.kept.get("", None if self.kept.get("list") is None else iter(self.kept["list"])) or (iter(()) if "list" in self.kept else None)

    def put(self, rows):
        self._call()
        self.kept["list"] = list(rows)

    def update(self, value):
        self._call()
        self.kept[""] = value

    def clear(self):
        self._call()
        self.kept.clear()

    def getValue(self, key):
        self._call()
        return self.kept.get(key)

    def updateValue(self, key, value):
        self._call()
        self.kept[key] = value

    def removeKey(self, key):
        self._call()
        self.kept.pop(key, None)

    def iterator(self):
        self._call()
        return iter(list(self.kept.items()))


def test_windows_of_a_key_take_few_state_calls():
    from herdlens.streaming.runs import _END_US, _Windows

    handle, every = _Counted(), 1000
    windows = _Windows(["pid"], every, 10_000_000, None, 0)
    windows.init(handle)
    starts = [every * i for i in range(-100, 400)]
    pdf = pd.DataFrame({"start": starts, "newest": [s + 5 for s in starts], "readings": 2, "total": 3.0})
    assert list(windows.handleInputRows(("a",), iter([pdf, pdf]), None)) == []
    assert handle.calls < 20
    end = pd.DataFrame({"start": [0], "newest": [_END_US], "readings": [0], "total": [0.0]})
    (out,) = windows.handleInputRows(("a",), iter([end]), None)
    assert handle.calls < 40
    assert sorted(out["window_start"].astype("int64").tolist()) == starts and set(out["readings"]) == {4} and set(out["mean"]) == {1.5}
    assert not out["late"].any() and windows.closed_to() == every * 400


def test_windows_that_are_over_leave_their_block():
    from herdlens.streaming.runs import _Windows

    windows = _Windows(["pid"], 10, 20, None, 0)
    windows.init(_Counted())
    pdf = pd.DataFrame({"start": [0, 10, 60], "newest": [4, 14, 64], "readings": 1, "total": 1.0})
    (out,) = windows.handleInputRows(("a",), iter([pdf]), None)
    assert out["window_start"].astype("int64").tolist() == [0, 10] and windows.closed_to() == 20
    late, = windows.handleInputRows(("a",), iter([pdf[:1]]), None)
    assert late["late"].all() and windows.end(("a",))["window_start"].astype("int64").tolist() == [60]
