"""Recorded runs from their folders to the final figures, against pandas on the same files."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from herdlens.plans.study import Study

START = pd.Timestamp("2026-04-16T20:57:54.289715")


def _iso(seconds: float) -> str:
    return (START + pd.Timedelta(microseconds=round(seconds * 1e6))).isoformat()


def _report(pid: str, animals: int, images: int, batch: bool, rng) -> dict:
    report = {"pid": pid, "load_model_start": _iso(0), "load_model_final": _iso(2.25), "animals": {}}
    for animal in range(1, animals + 1):
        first = 5 + animal * 13.5
        taken = range(1, images + 1) if not batch else [images + 4]
        entry = {"first_image_capture_time": _iso(first), "imgs": {}}
        for i in taken:
            begin = first + i * 0.7
            entry["imgs"][str(i)] = {"weight_prediction_start": _iso(begin), "weight_prediction_final": _iso(begin + rng.uniform(0.2, 0.6))}
        if batch:
            entry |= {"total_of_images": images + 4, "suitable_images": images}
        entry |= {"last_image_capture_time": _iso(first + 9.5), "weight_prediction_final": _iso(first + 10 + rng.uniform(0, 1))}
        report["animals"][str(animal)] = entry
    return report


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("reports"), np.random.default_rng(6)
    for pid, cores, batch in (("single_2026-04-16T20:57:54.289715", 4, False), ("batch_baseline", 2, True)):
        run = root / pid
        run.mkdir()
        (run / "metrics.json").write_text(json.dumps(_report(pid, 12, 3, batch, rng), indent=4))
        seconds = np.arange(300) * 1.001
        cpu = pd.DataFrame(rng.uniform(0, 100, (300, cores)).round(1), columns=[f"cpu_core_{i}" for i in range(cores)])
        cpu.insert(0, "timestamp", [_iso(s) for s in seconds])
        cpu.to_csv(run / "cpu.csv", index=False)
        names = ["total", "available", "used", "percent", "free", "active", "inactive", "buffers", "cached"]
        memory = pd.DataFrame(rng.integers(1, 10**9, (300, 9)), columns=names).assign(percent=rng.uniform(0, 100, 300).round(1))
        memory.insert(0, "timestamp", [_iso(s) for s in seconds])
        memory.to_csv(run / "mem.csv", index=False)
        shuffled = rng.permutation(300)
        power = pd.DataFrame({"Datetime": [_iso(s) for s in seconds], "Time[S]": seconds.round(1), "Volt[V]": 5.0, "Current[A]": 1.0})
        power["Power[W]"] = rng.uniform(2, 7, 300).round(4)
        power.iloc[shuffled].to_csv(run / ("single.csv" if not batch else "batch.csv"), index=False)
    return root


def _pandas_power(folder, pid, name):
    power = pd.read_csv(folder / pid / name)
    power["timestamp"] = pd.to_datetime(power["Datetime"])
    power = power.sort_values("timestamp")
    power["dt_hours"] = power["timestamp"].diff().dt.total_seconds() / 3600
    power["energy_wh"] = power["Power[W]"] * power["dt_hours"]
    return power


LOGS = {"single_2026-04-16T20:57:54.289715": "single.csv", "batch_baseline": "batch.csv"}


def test_energy_of_runs(spark, folder):
    got = {r.pid: r.energy_wh for r in Study(spark, str(folder)).energy().collect()}
    assert got == pytest.approx({p: _pandas_power(folder, p, f)["energy_wh"].sum() for p, f in LOGS.items()})


def _same_statistics(got: pd.DataFrame, want: pd.DataFrame):
    for theirs, ours in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "p25"), ("50%", "p50"), ("75%", "p75"), ("max", "max")):
        for column in want.columns:
            value = got[got.metric == column].iloc[0][ours]
            assert value == pytest.approx(want.loc[theirs, column], rel=1e-9), (column, ours)


def test_summaries_of_logs(spark, folder):
    study = Study(spark, str(folder))
    cpu, memory, power = (s.toPandas() for s in (study.cpu_summary(), study.memory_summary(), study.power_summary()))
    assert sorted(cpu[cpu.pid == "batch_baseline"].metric) == ["cpu_core_0", "cpu_core_1", "cpu_mean", "timestamp"]
    for pid, name in LOGS.items():
        log = pd.read_csv(folder / pid / "cpu.csv").drop(columns="timestamp")
        _same_statistics(cpu[cpu.pid == pid], log.assign(cpu_mean=log.mean(axis=1)).describe())
        _same_statistics(memory[memory.pid == pid], pd.read_csv(folder / pid / "mem.csv").drop(columns="timestamp").describe())
        want = _pandas_power(folder, pid, name)[["Power[W]", "dt_hours", "energy_wh", "Volt[V]"]].describe()
        mine = power[power.pid == pid]
        _same_statistics(mine, want)
        assert mine[mine.metric == "timestamp"]["std"].isna().all() and "Res[Ohm]" not in set(mine.metric)


def _pandas_images(folder, pid, last_image):
    data = json.loads((folder / pid / "metrics.json").read_text())
    rows = []
    for animal, a in data["animals"].items():
        images = list(a["imgs"].values())
        for m in images:
            used = images[-1] if last_image else m
            rows.append(
                {
                    "animal": animal,
                    "first": pd.Timestamp(a["first_image_capture_time"]),
                    "last": pd.Timestamp(a["last_image_capture_time"]),
                    "display": pd.Timestamp(a["weight_prediction_final"]),
                    "dur": pd.Timestamp(used["weight_prediction_final"]) - pd.Timestamp(used["weight_prediction_start"]),
                }
            )
    return pd.DataFrame(rows)


@pytest.mark.parametrize("last_image", [False, True])
def test_timing_of_animals_and_runs(spark, folder, last_image):
    study = Study(spark, str(folder), last_image=last_image)
    animals = study.animals().toPandas()
    runs = study.runs().toPandas().set_index("pid")
    for pid in LOGS:
        rows = _pandas_images(folder, pid, last_image)
        by = rows.groupby("animal").agg(first=("first", "min"), last=("last", "max"), display=("display", "max"), delay=("dur", "sum"))
        mine = animals[animals.pid == pid].assign(animal=lambda d: d.animal.astype(str)).set_index("animal").loc[by.index]
        us = pd.Timedelta(microseconds=1)
        assert (mine.lead_time_us == (by.display - by["first"]) / us).all()
        assert (mine.latency_us == (by.display - by["last"]) / us).all()
        assert (mine.processing_delay_us == by.delay / us).all()
        lead = by.display.max() - by["first"].min()
        run = runs.loc[pid]
        assert run.animals == 12 and run.collect_lead_time_us == lead / us
        assert run.total_processing_delay_us == by.delay.sum() / us
        assert run.throughput_per_hour == pytest.approx(12 / (lead.total_seconds() / 3600))
    assert runs.loc["batch_baseline"].fps == pytest.approx(12 * 7 / (runs.loc["batch_baseline"].collect_lead_time_us / 1e6))
    assert pd.isna(runs.loc["single_2026-04-16T20:57:54.289715"].fps)


def test_image_weighted_measures_reproduce_the_old_weights(spark, folder):
    pid = "single_2026-04-16T20:57:54.289715"
    got = Study(spark, str(folder), last_image=True, image_weighted=True).measures().toPandas()
    rows = _pandas_images(folder, pid, True)
    per_row = rows.assign(
        processing_delay_us=rows.groupby("animal")["dur"].transform("sum") / pd.Timedelta(microseconds=1),
        latency_us=(rows.display - rows["last"]) / pd.Timedelta(microseconds=1),
    )
    _same_statistics(got[got.pid == pid], per_row[["processing_delay_us", "latency_us"]].describe())
    assert set(got.metric) >= {"collect_lead_time_us", "throughput_per_hour"}


def test_report_summary_and_one_parse(spark, folder, monkeypatch):
    from herdlens.plans import study as module

    parses = []
    read = module.read_reports
    monkeypatch.setattr(module, "read_reports", lambda *a, **k: parses.append(1) or read(*a, **k))
    study = Study(spark, str(folder))
    got = study.report_summary().toPandas()
    study.runs().count()
    assert parses == [1]
    pid = "batch_baseline"
    mine = got[got.pid == pid].set_index("metric")
    rows = _pandas_images(folder, pid, False)
    us = pd.Timedelta(microseconds=1)
    want = (rows.dur / us).describe()
    assert mine.loc["weight_prediction_dur_us", "count"] == want["count"] and mine.loc["weight_prediction_dur_us", "p50"] == pytest.approx(want["50%"])
    assert mine.loc["display_time", "max"] == (rows.display.max() - pd.Timestamp(0)) / us and pd.isna(mine.loc["display_time", "std"])
    assert set(mine.index) >= {"load_model_dur_us", "total_of_images", "suitable_images", "first_image_capture_time", "load_model_start"}


def test_chart_series_and_comparison(spark, folder):
    study = Study(spark, str(folder))
    assert study.cpu_series().count() == 600 and study.power_series("10 seconds").count() < 70
    assert study.memory_histogram(10).groupBy("pid").sum("n").first()[1] == 300
    assert study.cpu_density(30).count() == 60
    settings = spark.createDataFrame(
        [(p, "x", "batch_baseline") for p in LOGS], "pid string, strategy string, baseline_pid string"
    )
    compared = {r.pid: r for r in study.compared(settings).collect()}
    assert compared["batch_baseline"].throughput_per_hour_delta == 0.0
    single = compared["single_2026-04-16T20:57:54.289715"]
    assert single.collect_lead_time_us_delta == single.collect_lead_time_us - compared["batch_baseline"].collect_lead_time_us
