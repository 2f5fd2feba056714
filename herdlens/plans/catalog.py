"""The registered queries: each runs library operators over whole given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from herdlens.functions.clock import epoch_micros, format_iso, micros_between, parse_iso
from herdlens.functions.values import row_mean
from herdlens.operators import enhance, flatten, passages, scoring, selection
from herdlens.operators.distribution import density, histogram, line_series
from herdlens.operators.energy import energy_by_run, power_intervals
from herdlens.operators.summary import describe
from herdlens.plans import metrics, tables
from herdlens.session import configure, shared_folder
from herdlens.sinks.report_files import write_report_files
from herdlens.sinks.reports import write_reports
from herdlens.sinks.telemetry import format_power, format_recording, write_power, write_recording, write_telemetry
from herdlens.sources import meter, telemetry
from herdlens.sources.frames import read_frames
from herdlens.sources.layout import PARTITIONED
from herdlens.sources.report_lines import read_report_images
from herdlens.sources.reports import read_reports
from herdlens.streaming import energy as energy_stream
from herdlens.streaming import frames as frame_stream
from herdlens.streaming import late_energy, runs
from herdlens.streaming import telemetry as telemetry_stream
from herdlens.streaming.tables import append_table, change_table, closable, latest, write_end, write_ends

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CORES = [f"cpu_core_{i}" for i in range(4)]
SHAPE = (12, 16)
CLIP = 1950.0


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(configure(spark), folder)

    QUERIES[function.__name__] = run
    return function


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def finish(*started: StreamingQuery) -> None:
    for stream in started:
        stream.awaitTermination()


# --- run reports -----------------------------------------------------------------------------------


def _image_rows(spark: SparkSession, folder: str) -> DataFrame:
    return tables.image_rows(tables.table(spark, folder, "events"))


def _animal_columns(animals: DataFrame) -> DataFrame:
    return animals.select("pid", "animal", "image_rows", "lead_time_us", "processing_delay_us", "latency_us")


@query
def animal_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _animal_columns(metrics.animal_metrics(_image_rows(spark, folder)))


@query
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    runs = metrics.run_metrics(metrics.animal_metrics(_image_rows(spark, folder)))
    return rounded(runs, 6, "mean_latency_us", "throughput_per_hour", "fps")


@query
def image_rows_with_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.image_rows_with_metrics(_image_rows(spark, folder))
    return rounded(rows, 6, "throughput_per_hour").select(
        "pid",
        "animal",
        "img",
        "display_time",
        "load_model_dur_us",
        "weight_prediction_dur_us",
        "lead_time_us",
        "processing_delay_us",
        "latency_us",
        "collect_lead_time_us",
        "throughput_per_hour",
    )


@query
def report_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Nested JSON documents written, read back, flattened, and measured."""
    path = shared_folder(spark, "reports")
    write_reports(_image_rows(spark, folder), path)
    return _animal_columns(metrics.animal_metrics(flatten.flatten_reports(read_reports(spark, path, lines=True))))


@query
def report_roundtrip_animals(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated image rows, and an animal without images beside every other one: one document per run keeps all.

    The parts of a long run are one document, which its part 0 counts for; of an animal in two parts each has some images.
    """
    rows = _image_rows(spark, folder)
    bare = rows.withColumn("animal", F.col("animal") + 100_000).dropDuplicates(["pid", "animal"])
    path = shared_folder(spark, "reports")
    write_reports(rows.unionByName(rows), path, animals=bare)
    documents = read_reports(spark, path, lines=True)
    found = flatten.explode_animals(documents).groupBy("pid", "animal").agg(F.sum(F.size("imgs")).alias("imgs"))
    animals = found.groupBy("pid").agg(
        F.count(F.lit(1)).alias("animals"), F.count_if(F.col("imgs") == 0).alias("without_images"), F.sum("imgs").alias("images")
    )
    return documents.groupBy("pid").agg(F.count_if(F.coalesce("part", F.lit(0)) == 0).alias("documents")).join(animals, "pid")


@query
def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """One indented document in each run's folder, read back as whole documents, and measured."""
    path = shared_folder(spark, "report-files")
    write_report_files(_image_rows(spark, folder), path)
    return _animal_columns(metrics.animal_metrics(flatten.flatten_reports(read_reports(spark, path))))


@query
def report_file_images(spark: SparkSession, folder: str) -> DataFrame:
    """The same documents read by the line: no document is ever whole in memory."""
    path = shared_folder(spark, "report-lines")
    write_report_files(_image_rows(spark, folder), path)
    return read_report_images(spark, path).groupBy("pid", "animal").agg(
        F.count(F.lit(1)).alias("images"), F.min("img").alias("first_img"), F.min("weight_prediction_start").alias("first_start"),
        F.max("weight_prediction_final").alias("last_final"), F.max("total_of_images").alias("total_of_images"), F.max("suitable_images").alias("suitable_images"),
    )


@query
def compat_last_image(spark: SparkSession, folder: str) -> DataFrame:
    rows = flatten.compat_last_image(_image_rows(spark, folder))
    return metrics.animal_metrics(rows).select("pid", "animal", "image_rows", "processing_delay_us")


@query
def model_load_time(spark: SparkSession, folder: str) -> DataFrame:
    rows = flatten.with_durations(_image_rows(spark, folder))
    return rows.groupBy("pid").agg(F.max("load_model_dur_us").alias("load_model_dur_us"))


@query
def compare_runs_unsettled(spark: SparkSession, folder: str) -> DataFrame:
    """Settings that lack a run: the run stays, without them."""
    measured = metrics.run_metrics(metrics.animal_metrics(_image_rows(spark, folder)))
    settings = tables.run_settings(spark).where("pid <> '1'")
    compared = metrics.compare_runs(measured, settings)
    return compared.select("pid", "strategy", "animals", "collect_lead_time_us", "collect_lead_time_us_delta")


@query
def compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    measured = metrics.run_metrics(metrics.animal_metrics(_image_rows(spark, folder)))
    compared = metrics.compare_runs(measured, tables.run_settings(spark))
    names = ["throughput_per_hour", "fps", "mean_latency_us"]
    return rounded(compared, 6, *names, *(f"{n}_delta" for n in names)).select(
        "pid",
        "strategy",
        "passage_time",
        "arrival_time",
        "window",
        "animals",
        "collect_lead_time_us",
        "total_processing_delay_us",
        *names,
        "collect_lead_time_us_delta",
        "total_processing_delay_us_delta",
        *(f"{n}_delta" for n in names),
    )


@query
def iso_times(spark: SparkSession, folder: str) -> DataFrame:
    """Timestamps written as ISO text and parsed again."""
    events = tables.table(spark, folder, "events")
    texts = events.select("user_id", "ts", format_iso("ts").alias("text"))
    parsed = texts.withColumn("back", parse_iso("text"))
    return parsed.groupBy("user_id").agg(
        F.min("back").alias("first_ts"),
        F.max("text").alias("last_text"),
        F.sum(micros_between("ts", "back")).alias("drift_us"),
        F.count("back").alias("parsed"),
    )


# --- energy and statistics -------------------------------------------------------------------------


@query
def run_energy(spark: SparkSession, folder: str) -> DataFrame:
    readings = tables.power_readings(tables.table(spark, folder, "events"))
    return rounded(energy_by_run(readings), 6, "energy_wh", "energy_kwh")


@query
def power_interval_rows(spark: SparkSession, folder: str) -> DataFrame:
    readings = tables.power_readings(tables.table(spark, folder, "events"))
    return power_intervals(readings, "event_id").select("pid", "event_id", "dt_hours", "energy_wh")


def _eight(df: DataFrame) -> DataFrame:
    """Microseconds to two digits, others to six; mean and deviation coarser, as sums depend on their order."""
    micros = F.endswith("metric", F.lit("_us")) | (F.col("metric") == "timestamp")

    def pick(column: str, of_micros: int, of_others: int) -> Column:
        return F.when(micros, F.round(column, of_micros)).otherwise(F.round(column, of_others))

    moments = {c: pick(c, -3, 3) for c in ("mean", "std")}
    return df.withColumns(moments | {c: pick(c, 2, 6) for c in ("min", "p25", "p50", "p75", "max")})


@query
def describe_reports(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.image_rows_with_metrics(_image_rows(spark, folder))
    names = ["weight_prediction_dur_us", "lead_time_us", "processing_delay_us", "latency_us", "throughput_per_hour"]
    return _eight(describe(rows, ["pid"], {n: F.col(n) for n in names}, keep=True))


@query
def describe_animals(spark: SparkSession, folder: str) -> DataFrame:
    animals = metrics.animal_metrics(_image_rows(spark, folder))
    names = ["lead_time_us", "processing_delay_us", "latency_us"]
    return _eight(describe(animals, ["pid"], {n: F.col(n) for n in names}, keep=True))


@query
def describe_power(spark: SparkSession, folder: str) -> DataFrame:
    rows = power_intervals(tables.power_readings(tables.table(spark, folder, "events")), "event_id")
    columns = {"power_w": F.col("`Power[W]`"), "dt_hours": F.col("dt_hours"), "energy_wh": F.col("energy_wh")}
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    columns["timestamp"] = epoch_micros("timestamp") - epoch_micros(start)
    return _eight(describe(rows, ["pid"], columns, timestamps=["timestamp"], keep=True))


@query
def describe_cpu(spark: SparkSession, folder: str) -> DataFrame:
    cpu = tables.cpu(tables.table(spark, folder, "lineitem")).withColumn("cpu_mean", row_mean(CORES))
    return _eight(describe(cpu, ["pid"], {n: F.col(n) for n in [*CORES, "cpu_mean"]}))


@query
def describe_memory(spark: SparkSession, folder: str) -> DataFrame:
    memory = tables.memory(tables.table(spark, folder, "orders"))
    return _eight(describe(memory, ["pid"], {n: F.col(n) for n in telemetry.MEMORY_FIELDS}))


@query
def core_mean(spark: SparkSession, folder: str) -> DataFrame:
    cpu = tables.cpu(tables.table(spark, folder, "lineitem")).withColumn("cpu_mean", row_mean(CORES))
    grouped = cpu.groupBy("pid").agg(
        F.avg("cpu_mean").alias("mean"), F.min("cpu_mean").alias("low"), F.max("cpu_mean").alias("high")
    )
    return rounded(grouped, 6, "mean", "low", "high")


@query
def histogram_cpu(spark: SparkSession, folder: str) -> DataFrame:
    cpu = tables.cpu(tables.table(spark, folder, "lineitem"))
    return rounded(histogram(cpu, ["pid"], "cpu_core_1", 20), 4, "bin_low", "bin_high")


@query
def kde_power(spark: SparkSession, folder: str) -> DataFrame:
    frames = tables.frame_events(tables.table(spark, folder, "events"))
    return rounded(density(frames, ["pid"], "weight", 200), 8, "x", "density")


@query
def kde_power_binned(spark: SparkSession, folder: str) -> DataFrame:
    """The same by way of 512 bins a run: its cost does not grow with the number of values."""
    frames = tables.frame_events(tables.table(spark, folder, "events"))
    return rounded(density(frames, ["pid"], "weight", 200, bins=512), 8, "x", "density")


@query
def line_series_cpu(spark: SparkSession, folder: str) -> DataFrame:
    cpu = tables.cpu(tables.table(spark, folder, "lineitem"))
    return rounded(line_series(cpu, ["pid"], "timestamp", "cpu_core_1"), 6, "mean")


@query
def telemetry_windows(spark: SparkSession, folder: str) -> DataFrame:
    readings = tables.power_readings(tables.table(spark, folder, "events"))
    return rounded(telemetry_stream.utilisation(readings, "Power[W]", "6 hours"), 6, "mean")


@query
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.first_rows(tables.power_readings(tables.table(spark, folder, "events")), ["timestamp", "event_id"])


@query
def first_rows_per_run(spark: SparkSession, folder: str) -> DataFrame:
    readings = tables.power_readings(tables.table(spark, folder, "events"))
    return metrics.first_rows_per_run(readings, ["timestamp", "event_id"]).select("pid", "event_id", "place")


# --- frames ----------------------------------------------------------------------------------------


@query
def frame_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """Every frame with its number and its elapsed time within its animal."""
    frames = tables.frame_events(tables.table(spark, folder, "events"))
    numbered = selection.with_ordinal(selection.with_elapsed(frames), "event_id")
    return rounded(numbered, 6, "elapsed").select("pid", "animal", "event_id", "img", "elapsed")


@query
def frame_table_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Frames written as a table and read back with only the columns asked for."""
    path = shared_folder(spark, "frames")
    _frames(spark, folder).write.parquet(path)
    return read_frames(spark, path).groupBy("pid", "animal").agg(
        F.count(F.lit(1)).alias("frames"), F.min("ts").alias("first_ts"), F.sum(F.size("pixels")).alias("pixels")
    )


@query
def suitable_frames(spark: SparkSession, folder: str) -> DataFrame:
    frames = selection.with_elapsed(tables.frame_events(tables.table(spark, folder, "events")))
    chosen = selection.suitable_frames(frames, tables.PASSAGE_TIME, tables.WINDOW)
    return chosen.groupBy("pid", "animal").agg(
        F.count(F.lit(1)).alias("frames"), F.min_by("event_id", "ts").alias("first_frame")
    )


@query
def frame_counters_fps(spark: SparkSession, folder: str) -> DataFrame:
    frames = selection.with_elapsed(tables.frame_events(tables.table(spark, folder, "events")))
    counters = selection.frame_counters(frames, tables.PASSAGE_TIME, tables.WINDOW)
    runs = counters.groupBy("pid").agg(
        F.sum("total_of_images").alias("total_of_images"),
        F.sum("suitable_images").alias("suitable_images"),
        micros_between(F.min("first_image_capture_time"), F.max("last_image_capture_time")).alias("span_us"),
    )
    rate = F.try_divide(F.col("total_of_images"), F.col("span_us") / 1e6)
    return rounded(runs.withColumn("captured_per_second", rate), 8, "captured_per_second")


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    return tables.frames(tables.table(spark, folder, "embeddings"))


def _frame_sums(frames: DataFrame) -> DataFrame:
    """Size, sum, and position-weighted sum of each frame's pixels."""
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x.cast("double"))
    placed = F.aggregate(
        F.zip_with("pixels", F.sequence(F.lit(1), F.size("pixels")), lambda x, k: x.cast("double") * k),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    return frames.select(
        "img", F.size("pixels").alias("size"), F.round(total, 4).alias("total"), F.round(placed, 2).alias("placed")
    )


@query
def clip_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _frame_sums(enhance.clip_frames(_frames(spark, folder), CLIP))


@query
def scale_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _frame_sums(enhance.scale_frames(_frames(spark, folder), CLIP))


@query
def replicate_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _frame_sums(enhance.replicate_frames(_frames(spark, folder), 3))


@query
def resize_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _frame_sums(enhance.resize_frames(_frames(spark, folder), SHAPE))


@query
def enhance_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _frame_sums(enhance.enhance_frames(_frames(spark, folder), CLIP, SHAPE, 3))


@query
def enhance_frames_builtin(spark: SparkSession, folder: str) -> DataFrame:
    return _frame_sums(enhance.enhance_small(_frames(spark, folder), CLIP, SHAPE, 3))


@query
def transform_chain(spark: SparkSession, folder: str) -> DataFrame:
    """A user's own transform between two of the library's."""

    def invert(frames: DataFrame) -> DataFrame:
        return frames.withColumn("pixels", F.transform("pixels", lambda x: F.lit(CLIP).cast("float") - x))

    chained = enhance.chain(
        _frames(spark, folder),
        lambda f: enhance.clip_frames(f, CLIP),
        invert,
        lambda f: enhance.replicate_frames(f, 2),
    )
    return _frame_sums(chained)


@query
def score_frames(spark: SparkSession, folder: str) -> DataFrame:
    scored = scoring.score_frames(_frames(spark, folder), tables.linear_model(64), [64])
    return scored.select("pid", "animal", "img", F.round(F.col("weight").cast("double"), 2).alias("weight"))


@query
def score_frames_singly(spark: SparkSession, folder: str) -> DataFrame:
    scored = scoring.score_frames(_frames(spark, folder), tables.linear_model(64), [64], batch_size=1)
    return scored.select("pid", "animal", "img", F.round(F.col("weight").cast("double"), 2).alias("weight"))


def _animal_scores(frames: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Enhanced and scored in one pass, then the mean weight of each animal."""
    scored = scoring.score_enhanced(frames, tables.linear_model(shape[0] * shape[1]), CLIP, shape, 3)
    return rounded(scoring.mean_weights(scored), 4, "mean_weight")


@query
def score_animals(spark: SparkSession, folder: str) -> DataFrame:
    return _animal_scores(_frames(spark, folder), SHAPE)


@query
def score_animals_default_shape(spark: SparkSession, folder: str) -> DataFrame:
    """The same with frames of the default size, 300 x 300 in three channels."""
    return _animal_scores(_frames(spark, folder), enhance.SHAPE)


@query
def score_packed_frames(spark: SparkSession, folder: str) -> DataFrame:
    """16-bit frames, half the bytes of floats, enhanced and scored like their float form."""
    packed = enhance.pack_frames(tables.whole_frames(tables.table(spark, folder, "embeddings")))
    return _animal_scores(packed, SHAPE)


@query
def resize_packed_frames(spark: SparkSession, folder: str) -> DataFrame:
    """16-bit frames resized as integers: as parts of the largest number that their type holds."""
    packed = enhance.pack_frames(tables.whole_frames(tables.table(spark, folder, "embeddings")))
    return _frame_sums(enhance.resize_packed_frames(packed, SHAPE))


@query
def passage_sessions(spark: SparkSession, folder: str) -> DataFrame:
    frames = tables.frame_events(tables.table(spark, folder, "events"))
    return rounded(passages.passage_sessions(frames, selection.PASSAGE, tables.GAP), 6, "mean_weight")


# --- files and meter packets -----------------------------------------------------------------------


# As many digits as the values carry, where these are not two: a sum then never lies between two roundings.
DIGITS = {"cpu_mean": 4, "Volt[V]": 4, "Current[A]": 5}


def _totals(df: DataFrame, columns: Sequence[str], *extra: Column) -> DataFrame:
    sums = [F.round(F.sum(F.col(f"`{c}`").cast("double")), DIGITS.get(c, 2)).alias(c) for c in columns]
    times = [F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")]
    return df.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), *times, *sums, *extra)


@query
def cpu_log_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "cpu")
    write_telemetry(tables.cpu(tables.table(spark, folder, "lineitem")), path)
    back = telemetry.core_columns(telemetry.read_cpu(spark, path, PARTITIONED), 4)
    return _totals(back, [*CORES, "cpu_mean"])


@query
def memory_log_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "mem")
    write_telemetry(tables.memory(tables.table(spark, folder, "orders")), path)
    return _totals(telemetry.read_memory(spark, path, PARTITIONED), telemetry.MEMORY_FIELDS)


@query
def gpu_log_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "gpu")
    write_telemetry(tables.gpu(tables.table(spark, folder, "events")), path)
    back = telemetry.read_gpu(spark, path, PARTITIONED)
    lengths = [F.sum(F.length(c)).alias(c) for c in telemetry.GPU_FIELDS]
    return _totals(back, [], *lengths, F.max("gpu_volts").alias("largest"))


@query
def power_log_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "power")
    write_power(tables.wide_readings(tables.table(spark, folder, "events")), path)
    columns = [c for c in telemetry.POWER_FIELDS if c != "Datetime"]
    return _totals(telemetry.read_power(spark, path, PARTITIONED), columns)


@query
def narrow_power_log_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "power-narrow")
    write_power(tables.wide_readings(tables.table(spark, folder, "events")), path, wide=False)
    columns = ["Volt[V]", "Current[A]", "Power[W]"]
    missing = F.count_if(F.col("`Res[Ohm]`").isNull() & F.col("`D-[V]`").isNull()).alias("narrow_rows")
    return _totals(telemetry.read_power(spark, path, PARTITIONED), columns, missing)


@query
def format_power_rows(spark: SparkSession, folder: str) -> DataFrame:
    return format_power(tables.wide_readings(tables.table(spark, folder, "events")))


@query
def meter_packets(spark: SparkSession, folder: str) -> DataFrame:
    packets = tables.packets(tables.table(spark, folder, "events"))
    good = meter.accepted(meter.decode_packets(packets, F.lit(tables.DEMO_KEY)))
    return rounded(good, 5, "Volt", "Current", "Power", "Resistance", "D_plus", "D_minus").drop("packet", "event_type")


@query
def meter_rejects(spark: SparkSession, folder: str) -> DataFrame:
    packets = tables.packets(tables.table(spark, folder, "events"))
    bad = meter.rejected(meter.decode_packets(packets, F.lit(tables.DEMO_KEY)), "event_id", "event_type", "packet")
    return bad.select("event_id", "event_type", F.length("packet").alias("bytes"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return meter.decode_recordings(tables.recordings(tables.table(spark, folder, "events")))


@query
def meter_recordings(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_records(spark, folder), 5, "Volt", "Current")


@query
def format_recording_rows(spark: SparkSession, folder: str) -> DataFrame:
    return format_recording(_records(spark, folder))


@query
def recording_log_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "recording")
    write_recording(_records(spark, folder), path)
    back = telemetry.read_recording(spark, path, PARTITIONED)
    sums = [F.round(F.sum(F.col(f"`{c}`")), DIGITS[c]).alias(c) for c in ("Volt[V]", "Current[A]")]
    return back.groupBy("pid", "Rec").agg(F.count(F.lit(1)).alias("n"), *sums)


# --- streams ---------------------------------------------------------------------------------------


@query
def score_stream(spark: SparkSession, folder: str) -> DataFrame:
    out, check = shared_folder(spark, "scores"), shared_folder(spark, "scores-check")
    frames = tables.frames(tables.stream_table(spark, folder, "embeddings"))
    model = tables.linear_model(SHAPE[0] * SHAPE[1])
    means = frame_stream.running_weights(frames, model, 8.0, 5.0, SHAPE, CLIP, 3)
    finish(change_table(means, out, check, keys=selection.PASSAGE))
    return rounded(latest(spark, out, selection.PASSAGE), 4, "mean_weight")


@query
def passage_stream(spark: SparkSession, folder: str) -> DataFrame:
    out, check = shared_folder(spark, "passages"), shared_folder(spark, "passages-check")
    frames = tables.frame_events(tables.stream_table(spark, folder, "events")).withColumn("elapsed", F.col("weight"))
    ends = shared_folder(spark, "passages-end")
    over = frame_stream.passage_weights(closable(frames, ends), selection.PASSAGE, tables.GAP, "1 hour", 100.0)
    finish(append_table(over, out, check))
    write_end(frames, ends, "ts")
    finish(append_table(over, out, check))
    return rounded(spark.read.parquet(out), 6, "mean_weight")


@query
def energy_stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    out, check = shared_folder(spark, "energy"), shared_folder(spark, "energy-check")
    readings = tables.power_readings(tables.stream_table(spark, folder, "events"))
    finish(energy_stream.integrate_stream(readings, out, check))
    return rounded(energy_stream.stream_energy(spark, out), 6, "energy_wh", "energy_kwh")


@query
def telemetry_stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    out, check = shared_folder(spark, "windows"), shared_folder(spark, "windows-check")
    readings = tables.power_readings(tables.stream_table(spark, folder, "events"))
    ends = shared_folder(spark, "windows-end")
    windows = telemetry_stream.utilisation_stream(closable(readings, ends), "Power[W]", "6 hours", "1 hour")
    finish(append_table(windows, out, check))
    write_end(readings, ends, "timestamp")
    finish(append_table(windows, out, check))
    return rounded(spark.read.parquet(out), 6, "mean")


# --- streams by the time of each run ----------------------------------------------------------------


def _run_stream(results: DataFrame, out: str, check: str, ends: str, keys: Sequence[str], timestamp: str, rows: DataFrame) -> None:
    """Run a stream over what is there, then once more over the ends of its keys."""
    finish(runs.run_table(results, out, check))
    write_ends(rows, ends, keys, timestamp)
    finish(runs.run_table(results, out, check))


@query
def telemetry_stream_by_run(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of every run by its own clock: no run is late because another one is newer."""
    out, check, ends = (shared_folder(spark, name) for name in ("run-windows", "run-windows-check", "run-windows-end"))
    readings = tables.power_readings(tables.stream_table(spark, folder, "events"))
    windows = runs.utilisation_by_run(closable(readings, ends), "Power[W]", "6 hours", "30 days")
    _run_stream(windows, out, check, ends, ["pid"], "timestamp", tables.power_readings(tables.table(spark, folder, "events")))
    return rounded(spark.read.parquet(out).where("NOT late").drop("late"), 6, "mean")


@query
def passage_stream_by_run(spark: SparkSession, folder: str) -> DataFrame:
    out, check, ends = (shared_folder(spark, name) for name in ("run-passages", "run-passages-check", "run-passages-end"))
    shape = lambda events: tables.frame_events(events).withColumn("elapsed", F.col("weight"))
    over = runs.passages_by_run(closable(shape(tables.stream_table(spark, folder, "events")), ends), tables.GAP, "30 days", 100.0)
    _run_stream(over, out, check, ends, selection.PASSAGE, "ts", shape(tables.table(spark, folder, "events")))
    return rounded(spark.read.parquet(out).where("NOT late").drop("late"), 6, "mean_weight")


@query
def raw_frame_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw frames, whose start no one tells: horizon, selection, enhancement, scoring and counters on the stream."""
    out, check, ends = (shared_folder(spark, name) for name in ("run-frames", "run-frames-check", "run-frames-end"))
    raw = tables.frames(tables.stream_table(spark, folder, "embeddings")).drop("elapsed")
    model = tables.linear_model(SHAPE[0] * SHAPE[1])
    scored = runs.scored_passages(closable(raw, ends), model, tables.RAW_PASSAGE, tables.RAW_WINDOW, "1 day", CLIP, SHAPE, 3)
    _run_stream(scored, out, check, ends, selection.PASSAGE, "ts", tables.frames(tables.table(spark, folder, "embeddings")).drop("elapsed"))
    return rounded(runs.passage_results(spark.read.parquet(out)), 4, "mean_weight")


@query
def energy_stream_any_order(spark: SparkSession, folder: str) -> DataFrame:
    out, check = shared_folder(spark, "run-energy"), shared_folder(spark, "run-energy-check")
    readings = tables.power_readings(tables.stream_table(spark, folder, "events"))
    finish(late_energy.integrate_any_order(readings, out, check, "2 days", "6 hours"))
    return rounded(late_energy.energy_so_far(spark, out), 6, "energy_wh", "energy_kwh")
