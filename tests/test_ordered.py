"""Ordered operators against pandas, on keys that are far larger than one slice."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from herdlens.operators.energy import energy_by_run, power_intervals
from herdlens.operators.ordered import number_rows, running_total, with_previous
from herdlens.operators.summary import describe


@pytest.fixture(scope="module")
def skewed() -> pd.DataFrame:
    """One key with half of the rows, copies of an instant, many keys with a row each, a key of NULL."""
    rng = np.random.default_rng(7)
    keys = ["hot"] * 2000 + [f"k{i % 40}" for i in range(1200)] + [f"single{i}" for i in range(300)] + [None] * 20
    frame = pd.DataFrame({"pid": keys, "id": np.arange(len(keys)), "t": rng.integers(0, 700, len(keys))})
    frame["n"] = rng.integers(1, 5, len(keys))
    return frame.sample(frac=1, random_state=1)


def _expected(frame: pd.DataFrame) -> pd.DataFrame:
    ordered = frame.sort_values(["pid", "t", "id"])
    groups = ordered.groupby("pid", dropna=False)
    ordered["ordinal"] = groups.cumcount() + 1
    ordered["total"] = groups["n"].cumsum()
    ordered["before"] = groups["t"].shift()
    return ordered.set_index("id").sort_index()


def test_row_numbers_totals_and_previous_values(many_slices, skewed):
    df = many_slices.createDataFrame(skewed)
    want = _expected(skewed)
    key, order = ["pid"], ["t", "id"]
    numbered = number_rows(df, key, order).toPandas().set_index("id").sort_index()
    assert numbered["ordinal"].tolist() == want["ordinal"].tolist()
    totals = running_total(df, key, order, "n", "total").toPandas().set_index("id").sort_index()
    assert totals["total"].tolist() == want["total"].tolist()
    lagged = with_previous(df, key, order, "t", "before").toPandas().set_index("id").sort_index()
    pd.testing.assert_series_equal(lagged["before"], want["before"], check_dtype=False, check_names=False)


def test_hot_key_is_cut_over_several_tasks(many_slices, skewed):
    from herdlens.operators.ordered import slices

    df = many_slices.createDataFrame(skewed)
    placed = slices(df, ["pid"], ["t", "id"]).withColumn("task", F.spark_partition_id())
    tasks = placed.where("pid = 'hot'").select("task").distinct().count()
    assert tasks >= 3


def test_small_arrow_batches_carry_over(many_slices, skewed):
    many_slices.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = many_slices.createDataFrame(skewed)
        got = running_total(df, ["pid"], ["t", "id"], "n", "total").toPandas().set_index("id").sort_index()
        assert got["total"].tolist() == _expected(skewed)["total"].tolist()
        got = with_previous(df, ["pid"], ["t", "id"], "t", "before").toPandas().set_index("id").sort_index()
        pd.testing.assert_series_equal(got["before"], _expected(skewed)["before"], check_dtype=False, check_names=False)
    finally:
        many_slices.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def _readings(spark, frame: pd.DataFrame):
    return spark.createDataFrame(frame).select(
        F.coalesce("pid", F.lit("none")).alias("pid"),
        F.timestamp_add("SECOND", "t", F.lit("2026-01-01").cast("timestamp_ntz")).alias("timestamp"),
        F.col("n").cast("double").alias("Power[W]"),
        "id",
    )


def _energy(frame: pd.DataFrame) -> pd.Series:
    """Sorted by time, smallest power first within an instant, as the operator orders them."""
    ordered = frame.assign(pid=frame["pid"].fillna("none")).sort_values(["pid", "t", "n"])
    hours = ordered.groupby("pid")["t"].diff() / 3600
    return (ordered["n"] * hours).groupby(ordered["pid"]).sum()


@pytest.mark.parametrize("batch", ["10000", "11"])
def test_energy_over_slices(many_slices, skewed, batch):
    many_slices.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = energy_by_run(_readings(many_slices, skewed)).toPandas().set_index("pid")["energy_wh"].sort_index()
    finally:
        many_slices.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = _energy(skewed).sort_index()
    assert got.index.tolist() == want.index.tolist()
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)


def test_interval_rows_sum_to_the_energy(many_slices, skewed):
    rows = power_intervals(_readings(many_slices, skewed), "Power[W]", "id").toPandas()
    assert len(rows) == len(skewed)
    np.testing.assert_allclose(rows.groupby("pid")["energy_wh"].sum(), _energy(skewed), rtol=1e-12, atol=1e-12)


def test_energy_ignores_missing_power_and_time(spark):
    readings = spark.sql("""
        SELECT * FROM VALUES
            ('a', timestamp_ntz'2026-01-01 00:00:00', 10D), ('a', timestamp_ntz'2026-01-01 01:00:00', double('NaN')),
            ('a', timestamp_ntz'2026-01-01 02:00:00', 20D), ('a', CAST(NULL AS timestamp_ntz), 99D),
            ('a', timestamp_ntz'2026-01-01 03:00:00', CAST(NULL AS double)), ('b', timestamp_ntz'2026-01-01 00:00:00', 5D),
            ('c', timestamp_ntz'2026-01-01 00:00:00', CAST(NULL AS double)),
            ('c', timestamp_ntz'2026-01-01 01:00:00', CAST(NULL AS double))
        AS t(pid, timestamp, `Power[W]`)""")
    got = {r.pid: (r.energy_wh, r.energy_kwh) for r in energy_by_run(readings).collect()}
    # The missing reading at 01:00 still ends the interval before it.
    assert got == {"a": (20.0, 0.02), "b": (0.0, 0.0), "c": (0.0, 0.0)}


def test_describe_matches_pandas(many_slices, skewed):
    frame = skewed.assign(pid=skewed["pid"].fillna("none"), x=np.sin(skewed["t"].to_numpy()) * 100)
    frame.loc[frame["id"] % 17 == 0, "x"] = np.nan
    df = many_slices.createDataFrame(frame)
    got = describe(df, ["pid"], {"x": F.col("x"), "t": F.col("t")}).toPandas()
    for metric in ("x", "t"):
        mine = got[got["metric"] == metric].set_index("pid").sort_index()
        want = frame.groupby("pid")[metric].describe().sort_index()
        want = want[want["count"] > 0]
        assert mine["count"].tolist() == want["count"].astype(int).tolist()
        for ours, theirs in (("mean",) * 2, ("std",) * 2, ("min",) * 2, ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max",) * 2):
            np.testing.assert_allclose(mine[ours].astype(float), want[theirs], rtol=1e-9, atol=1e-9, err_msg=f"{metric} {ours}")


def test_describe_leaves_deviation_of_timestamps_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "pid string, at double")
    row = describe(df, ["pid"], {"at": F.col("at")}, timestamps=["at"]).first()
    assert (row["std"], row["mean"], row["p50"]) == (None, 2.0, 2.0)


def test_group_joins_keep_null_keys_and_start_no_job(spark):
    from herdlens.operators.distribution import density, histogram
    from herdlens.operators.grouped import attach

    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 6.0)], "pid string, x double")
    spark.sparkContext.setJobGroup("attach", "attach")
    joined = attach(df, ["pid"], F.sum("x").alias("total"))
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("attach")) == []
    assert sorted((r.pid or "", r.x, r.total) for r in joined.collect()) == [("", 5.0, 11.0), ("", 6.0, 11.0), ("a", 1.0, 4.0), ("a", 3.0, 4.0)]
    assert joined.columns == ["pid", "x", "total"]
    assert {r.pid for r in histogram(df, ["pid"], "x", 2).collect()} == {"a", None}
    assert {r.pid for r in density(df, ["pid"], "x", 3).collect()} == {"a", None}
    assert {r.pid for r in describe(df, ["pid"], {"x": F.col("x")}).collect()} == {"a", None}


def test_hot_key_is_split_in_a_join_beyond_the_bound(spark):
    from herdlens.operators.grouped import join_groups

    hot = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000)
    rows = spark.range(0, 300_000, 1, 8).select(hot.alias("k"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    sizes = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "300k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        joined = join_groups(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"])
        by_key = joined.groupBy("k").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
        assert by_key.where("rows <> n").count() == 0
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in sizes:
            spark.conf.unset(name)


def test_empty_input_gives_empty_results(spark):
    rows = spark.createDataFrame([], "pid string, t bigint, id bigint, timestamp timestamp_ntz, `Power[W]` double")
    assert number_rows(rows, ["pid"], ["t", "id"]).count() == 0
    assert with_previous(rows, ["pid"], ["t", "id"], "t").count() == 0
    assert describe(rows, ["pid"], {"t": F.col("t")}).count() == 0
    assert energy_by_run(rows).count() == 0
    assert power_intervals(rows, "id").count() == 0


def test_slices_that_hold_one_key_each(many_slices):
    """More slices than values: keys without a change inside a slice, and slices without rows."""
    rows = [("a", i) for i in range(6)] + [("b", 0)]
    df = many_slices.createDataFrame(rows, "pid string, t bigint").repartition(3)
    got = {(r.pid, r.t): (r.ordinal, r.before) for r in with_previous(number_rows(df, ["pid"], ["t"]), ["pid"], ["t"], "t", "before").collect()}
    assert got == {("a", i): (i + 1, i - 1 if i else None) for i in range(6)} | {("b", 0): (1, None)}


def test_ordered_operators_start_no_job_and_cut_hot_keys(spark, skewed):
    """In a plan of built-in functions; a key with half of the rows, and one with all rows at one instant, are cut."""
    from herdlens.operators.ordered import _COARSE, _FINE, _cut

    instant = pd.DataFrame({"pid": ["flat"] * 900, "id": np.arange(90_000, 90_900), "t": 3, "n": 1})
    frame = pd.concat([skewed, instant])
    df = spark.createDataFrame(frame)
    spark.sparkContext.setJobGroup("ordered", "ordered")
    made = [number_rows(df, ["pid"], ["t", "id"], bucket_rows=100), running_total(df, ["pid"], ["t", "id"], "n", bucket_rows=100)]
    made.append(with_previous(df, ["pid"], ["t", "id"], "t", bucket_rows=100))
    described = describe(df, ["pid"], {"t": F.col("t")})
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("ordered")) == []
    want = _expected(frame)
    for got, (mine, theirs) in zip(made, (("ordinal", "ordinal"), ("running_total", "total"), ("previous", "before")), strict=True):
        pdf = got.toPandas().set_index("id").sort_index()
        pd.testing.assert_series_equal(pdf[mine], want[theirs], check_dtype=False, check_names=False)
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert described.count() == frame["pid"].nunique(dropna=False)
    buckets = _cut(df, ["pid"], ["t", "id"], 100).groupBy("pid", _COARSE, _FINE).count().toPandas()
    assert buckets["count"].max() <= 400
    assert (buckets["pid"] == "hot").sum() >= 10 and (buckets["pid"] == "flat").sum() >= 9


def test_quartiles_of_odd_distributions_are_exact(spark):
    """Values crowded into one bin of one bin, infinities, one value, two values, and a group of NULL."""
    draw = np.random.default_rng(3)
    values = {
        "crowded": np.concatenate([draw.normal(size=500) * 1e-9, [1e9, -1e9]]),
        "wide": np.concatenate([10.0 ** draw.uniform(-300, 300, 400), -(10.0 ** draw.uniform(-300, 300, 400))]),
        "infinite": np.array([-np.inf, 1.0, 2.0, 3.0, 4.0, 5.0, np.inf]),
        "one": np.array([7.0]),
        "same": np.full(9, 2.5),
        "two": np.array([1.0, 2.0]),
        "few": draw.integers(0, 3, 1000).astype(float),
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(None, 4.0), (None, 8.0), ("nan", float("nan"))]
    got = {r.pid: r for r in describe(spark.createDataFrame(rows, "pid string, x double"), ["pid"], {"x": F.col("x")}).collect()}
    assert set(got) == {*values, None}
    for k, vs in [*values.items(), (None, np.array([4.0, 8.0]))]:
        for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            assert got[k][name] == pytest.approx(np.quantile(vs, q), rel=1e-12), (k, name)
        assert got[k]["count"] == len(vs) and got[k]["min"] == vs.min() and got[k]["max"] == vs.max()
