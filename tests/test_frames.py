"""Frame operators against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from herdlens.operators import enhance, passages, scoring, selection
from herdlens.operators.distribution import density, histogram, line_series


def _frame_table(spark, arrays: list[np.ndarray]):
    rows = [("r", i % 2, i, *a.shape, a.reshape(-1).tolist()) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "pid string, animal int, img int, h int, w int, pixels array<float>")


def _pixels(df) -> dict[int, np.ndarray]:
    return {r.img: np.array(r.pixels, dtype=np.float32) for r in df.collect()}


def _resize_by_loops(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Pixel by pixel, after the published definition; sizes in single precision."""
    h, w = a.shape
    f = np.float32
    ratio = max(f(w) / f(shape[1]), f(h) / f(shape[0]))
    exact_h, exact_w = f(h) / ratio, f(w) / ratio
    rh, rw = math.floor(exact_h), math.floor(exact_w)
    top = max(0, math.floor((f(shape[0]) - exact_h) / f(2)))
    left = max(0, math.floor((f(shape[1]) - exact_w) / f(2)))
    out = np.zeros(shape)
    for i in range(rh):
        for j in range(rw):
            y, x = (i + 0.5) * h / rh - 0.5, (j + 0.5) * w / rw - 0.5
            y0, y1, x0, x1 = max(0, math.floor(y)), min(h - 1, math.ceil(y)), max(0, math.floor(x)), min(w - 1, math.ceil(x))
            fy, fx = y - math.floor(y), x - math.floor(x)
            upper = a[y0, x0] * (1 - fx) + a[y0, x1] * fx
            lower = a[y1, x0] * (1 - fx) + a[y1, x1] * fx
            out[top + i, left + j] = upper * (1 - fy) + lower * fy
    return out


@pytest.fixture(scope="module")
def arrays() -> list[np.ndarray]:
    rng = np.random.default_rng(3)
    return [rng.uniform(0, 4000, s).astype(np.float32) for s in ((6, 9), (9, 6), (5, 5), (1, 7), (20, 31), (6, 9))]


@pytest.mark.parametrize("shape", [(12, 16), (8, 5), (3, 3), (30, 30)])
def test_resize_both_ways(spark, arrays, shape):
    table = _frame_table(spark, arrays)
    builtin = _pixels(enhance.resize_frames(table, shape))
    for i, a in enumerate(arrays):
        want = _resize_by_loops(a.astype(np.float64), shape)
        np.testing.assert_allclose(builtin[i].reshape(shape), want, rtol=1e-6, atol=1e-4)
        np.testing.assert_allclose(enhance.resize_stack(a[None], shape)[0], want, rtol=1e-6, atol=1e-4)


def test_default_shape_of_a_sensor_frame():
    a = np.random.default_rng(1).uniform(0, 1, (48, 64)).astype(np.float32)
    got = enhance.resize_stack(a[None], (300, 300))[0]
    np.testing.assert_allclose(got, _resize_by_loops(a.astype(np.float64), (300, 300)), rtol=1e-5, atol=1e-6)
    assert not got[:37].any() and got[40].any() and not got[263:].any()


def test_clip_scale_and_replicate(spark):
    a = np.array([[1949.5, 1950.0, 1951.0], [np.nan, -1.0, 5000.0]], dtype=np.float32)
    table = _frame_table(spark, [a])
    np.testing.assert_array_equal(_pixels(enhance.clip_frames(table))[0], np.float32([1949.5, 1950, 1950, np.nan, -1, 1950]))
    np.testing.assert_array_equal(_pixels(enhance.scale_frames(table))[0], (a / np.float32(1950)).reshape(-1))
    np.testing.assert_array_equal(_pixels(enhance.replicate_frames(table))[0], np.repeat(a.reshape(-1), 3))


def test_whole_chain_is_the_same_in_both_forms(spark, arrays):
    table = _frame_table(spark, arrays)
    arrow = _pixels(enhance.enhance_frames(table, shape=(12, 16), frames_per_batch=2))
    builtin = _pixels(enhance.enhance_small(table, shape=(12, 16)))
    for i, a in enumerate(arrays):
        clipped = np.where(a >= 1950, 1950, a).astype(np.float32) / np.float32(1950)
        want = np.repeat(_resize_by_loops(clipped.astype(np.float64), (12, 16)).reshape(-1), 3)
        np.testing.assert_allclose(arrow[i], want, rtol=1e-6, atol=1e-6)
        np.testing.assert_allclose(builtin[i], want, rtol=1e-6, atol=1e-6)


def test_nan_pixels_stay_local(spark):
    a = np.ones((4, 4), dtype=np.float32)
    a[0, 0] = np.nan
    for form in (enhance.enhance_small, enhance.enhance_frames):
        got = _pixels(form(_frame_table(spark, [a]), shape=(4, 4), channels=1))[0]
        assert np.isnan(got[0]) and np.isfinite(got[1:]).all()


def _mean_model():
    def predict(batch: np.ndarray) -> np.ndarray:
        assert batch.shape[1:] == (12, 16, 3)
        return batch.reshape(len(batch), -1).mean(axis=1, keepdims=True)

    return predict


def test_scoring_in_one_pass_equals_two_steps(spark, arrays):
    table = _frame_table(spark, arrays)
    scored = scoring.score_enhanced(table, _mean_model, shape=(12, 16), batch_size=4)
    enhanced = _pixels(enhance.enhance_frames(table, shape=(12, 16)))
    weights = {r.img: r.weight for r in scored.select("img", "weight").collect()}
    for i, pixels in enhanced.items():
        assert weights[i] == pytest.approx(float(pixels.mean()), rel=1e-5)
    means = {r.animal: (r.mean_weight, r.scored_images) for r in scoring.mean_weights(scored).collect()}
    assert means[0][0] == pytest.approx(np.mean([weights[i] for i in (0, 2, 4)]), rel=1e-6) and means[0][1] == 3


def test_model_sees_only_suitable_frames(spark):
    rows = [("r", 1, i, 1, 1, [float(i)], e) for i, e in enumerate([0.0, 2.9, 3.0, 3.1, 10.0])]
    table = spark.createDataFrame(rows, "pid string, animal int, img int, h int, w int, pixels array<float>, elapsed double")
    chosen = selection.suitable_frames(table, passage_time=10, window=3)
    assert sorted(r.img for r in chosen.collect()) == [0, 1, 2]
    assert chosen.where(selection.in_passage(3.0)).count() == 2  # the horizon is exclusive
    counted = table.withColumn("ts", F.lit("2026-01-01").cast("timestamp_ntz"))
    row = selection.frame_counters(counted, passage_time=10, window=3).first()
    assert (row.total_of_images, row.suitable_images) == (4, 3)


def test_selection_reaches_the_scan(spark, tmp_path):
    rows = [("r", 1, i, 1, 1, [float(i)], float(i)) for i in range(5)]
    spark.createDataFrame(
        rows, "pid string, animal int, img int, h int, w int, pixels array<float>, elapsed double"
    ).write.parquet(f"{tmp_path}/frames")
    chosen = selection.suitable_frames(spark.read.parquet(f"{tmp_path}/frames"), 10, 3)
    plan = scoring.score_enhanced(chosen, _mean_model, shape=(12, 16)).select("img", "weight")._jdf.queryExecution().toString()
    assert "LessThanOrEqual(elapsed,3.0)" in plan and "LessThan(elapsed,10.0)" in plan


# --- passages and distributions --------------------------------------------------------------------


def test_passages_are_cut_as_session_windows_cut_them(spark):
    rng = np.random.default_rng(5)
    seconds = np.concatenate([rng.integers(0, 4000, 300), [5000, 5010, 5020, 5031, 5041]])
    rows = pd.DataFrame({"pid": np.where(np.arange(305) % 3 == 0, "b", "a"), "s": seconds, "weight": rng.uniform(0, 9, 305)})
    df = spark.createDataFrame(rows).select(
        "pid", "weight", F.timestamp_add("SECOND", "s", F.lit("2026-01-01").cast("timestamp_ntz")).alias("ts")
    )
    mine = passages.passage_sessions(df, ["pid"], 10).select("pid", "session_start", "frames", F.round("mean_weight", 9))
    windows = df.groupBy("pid", F.session_window("ts", "10 seconds").alias("w")).agg(F.count("*").alias("n"), F.avg("weight").alias("m"))
    theirs = windows.select("pid", "w.start", "n", F.round("m", 9))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect()))


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    values = [0.0, 0.5, 1.0, 9.99, 10.0, 10.0]
    rows = [("a", v) for v in values] + [("flat", 3.0), ("flat", 3.0), ("a", None), ("a", float("nan"))]
    got = histogram(spark.createDataFrame(rows, "pid string, x double"), ["pid"], "x", 10).toPandas().sort_values("bin")
    counts, edges = np.histogram(values, 10)
    a = got[got.pid == "a"]
    assert a.n.tolist() == counts.tolist()
    np.testing.assert_allclose(a.bin_low, edges[:-1])
    flat_counts, flat_edges = np.histogram([3.0, 3.0], 10)
    flat = got[got.pid == "flat"]
    assert flat.n.tolist() == flat_counts.tolist()
    np.testing.assert_allclose(flat.bin_high, flat_edges[1:])


def test_density_equals_the_kernel_sum(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(50, 10, 400), 1)
    rows = [("a", float(v)) for v in values] + [("flat", 1.0), ("flat", 1.0), ("one", 2.0)]
    got = density(spark.createDataFrame(rows, "pid string, x double"), ["pid"], "x", grid=60).toPandas().sort_values("point")
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 60)
    want = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    a = got[got.pid == "a"]
    np.testing.assert_allclose(a.x, grid)
    np.testing.assert_allclose(a.density, want)
    assert got[got.pid != "a"].density.isna().all()


def test_line_series_and_down_sampling(spark):
    df = spark.sql("""SELECT 'a' AS pid, timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) AS t, v
                      FROM VALUES (3, 1D), (3, 3D), (1, 5D), (12, 7D) AS x(s, v)""")
    assert [r.mean for r in line_series(df, ["pid"], "t", "v").collect()] == [5.0, 2.0, 7.0]
    assert [r.mean for r in line_series(df, ["pid"], "t", "v", every="10 seconds").collect()] == [3.0, 7.0]


def test_model_is_made_once_per_worker_and_bad_frames_get_no_weight(spark, tmp_path):
    folder = str(tmp_path)

    def make_predict():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda batch: batch.reshape(len(batch), -1).sum(1)

    good = "transform(sequence(1, 4), x -> cast(x AS float))"
    rows = spark.range(0, 64, 1, 16).selectExpr(
        "id", f"CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN array(1f) ELSE {good} END AS pixels", "2 AS h", "2 AS w"
    )
    for _ in range(2):
        scored = scoring.score_enhanced(rows, make_predict, max_value=4, shape=(2, 2), channels=1).collect()
        assert {r.id % 4 for r in scored if r.weight is None} == {0, 1}
        assert len({r.weight for r in scored if r.weight is not None}) == 1
    made = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert len(made) <= 2 * len(set(made))  # one for each query and worker, not for each task
    enhanced = enhance.enhance_frames(rows, 4, (2, 2), 1).collect()
    assert all((r.pixels is None) == (r.id % 4 < 2) for r in enhanced)


def test_passages_of_one_key_are_cut_over_parts(spark):
    """One key with a small gap: the same passages whatever the size of a part, NULL keys included."""
    rng = np.random.default_rng(12)
    seconds = np.sort(rng.choice(4000, 1500, replace=False))
    rows = [(None if s % 3000 == 7 else "hot", pd.Timestamp("2026-01-01") + pd.Timedelta(seconds=int(s)), float(s % 7)) for s in seconds]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["pid", "ts", "weight"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    whole = passages.passage_sessions(df, ["pid"], 2, slots_per_part=1_000_000)
    cut = passages.passage_sessions(df, ["pid"], 2, slots_per_part=5)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    hot = [s for s in seconds if s % 3000 != 7]
    assert cut.where("pid = 'hot'").count() == 1 + sum(b - a > 2 for a, b in zip(hot, hot[1:]))
