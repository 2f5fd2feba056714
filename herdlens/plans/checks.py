"""Independent SQL (DuckDB dialect) for the registered queries, over the same tables."""

from __future__ import annotations

# Fixed values shared with the stand-in tables.
_GAP_US = 1_800_000_000
_PASSAGE_US = 1_728_000_000_000
_WINDOW_US = 864_000_000_000

_IMAGES = """
f AS (
    SELECT CAST(user_id % 3 AS VARCHAR) AS pid, CAST(user_id AS INTEGER) AS animal, CAST(event_id AS INTEGER) AS img,
           ts AS started, ts + to_microseconds(CAST(round(value * 1000) AS BIGINT)) AS final, value
    FROM events),
g AS (
    SELECT pid, animal, min(started) AS first_capture, max(started) AS last_capture, max(final) AS display_time,
           count(*) AS total_of_images, count(*) FILTER (WHERE value <= 50) AS suitable_images,
           CAST(sum(epoch_us(final) - epoch_us(started)) AS BIGINT) AS processing_delay_us
    FROM f GROUP BY pid, animal),
a AS (
    SELECT *, epoch_us(display_time) - epoch_us(first_capture) AS lead_time_us,
           epoch_us(display_time) - epoch_us(last_capture) AS latency_us
    FROM g),
r AS (
    SELECT pid, count(*) AS animals, epoch_us(max(display_time)) - epoch_us(min(first_capture)) AS collect_lead_time_us,
           CAST(sum(processing_delay_us) AS BIGINT) AS total_processing_delay_us, avg(latency_us) AS mean_latency_us,
           (5 + CAST(pid AS BIGINT)) * 1000000 AS load_model_dur_us,
           CAST(sum(total_of_images) AS BIGINT) AS total_of_images, CAST(sum(suitable_images) AS BIGINT) AS suitable_images
    FROM a GROUP BY pid),
rr AS (
    SELECT *, animals / (collect_lead_time_us / 3.6e9) AS throughput_per_hour,
           total_of_images / (collect_lead_time_us / 1e6) AS fps
    FROM r),
ir AS (
    SELECT f.pid, f.animal, f.img, a.display_time, rr.load_model_dur_us,
           epoch_us(f.final) - epoch_us(f.started) AS weight_prediction_dur_us, a.lead_time_us, a.processing_delay_us,
           a.latency_us, rr.collect_lead_time_us, rr.throughput_per_hour
    FROM f JOIN a USING (pid, animal) JOIN rr USING (pid))
"""

_ANIMALS = f"""
WITH {_IMAGES}
SELECT pid, animal, total_of_images AS image_rows, lead_time_us, processing_delay_us, latency_us FROM a
"""

_POWER = """
p AS (
    SELECT CAST(user_id AS VARCHAR) AS pid, ts AS "timestamp", value AS power_w, event_id,
           epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dt_us
    FROM events),
pe AS (SELECT *, dt_us / 3.6e9 AS dt_hours, power_w * (dt_us / 3.6e9) AS energy_wh FROM p)
"""

_ENERGY = f"""
WITH {_POWER}
SELECT pid, round(coalesce(sum(energy_wh), 0), 6) AS energy_wh, round(coalesce(sum(energy_wh), 0) / 1000, 6) AS energy_kwh
FROM pe GROUP BY pid
"""


def _describe(source: str, columns: dict[str, str], timestamps: tuple[str, ...] = ()) -> str:
    """Microseconds to two digits, others to six; mean and deviation coarser, as sums depend on their order."""
    long = " UNION ALL ".join(
        f"SELECT pid, '{name}' AS metric, CAST({expression} AS DOUBLE) AS value FROM {source}"
        for name, expression in columns.items()
    )
    micros = [name for name in columns if name.endswith("_us") or name in timestamps]

    def pick(expression: str, of_micros: int, of_others: int) -> str:
        cases = " ".join(
            f"WHEN '{name}' THEN round({expression}, {of_micros if name in micros else of_others})" for name in columns
        )
        return f"CASE metric {cases} END"

    std = pick("stddev_samp(value)", -3, 3)
    if timestamps:
        std = f"CASE WHEN metric NOT IN ({', '.join(repr(t) for t in timestamps)}) THEN {std} END"
    quartiles = ", ".join(f"{pick(f'quantile_cont(value, {q})', 2, 6)} AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75))
    return f"""
    SELECT pid, metric, count(value) AS "count", {pick("avg(value)", -3, 3)} AS mean, {std} AS std,
           {pick("min(value)", 2, 6)} AS "min", {quartiles}, {pick("max(value)", 2, 6)} AS "max"
    FROM ({long}) WHERE value IS NOT NULL GROUP BY pid, metric
    """


_CPU = """
c AS (
    SELECT CAST(l_linenumber AS VARCHAR) AS pid, l_shipdate AS "timestamp", l_quantity AS cpu_core_0,
           l_extendedprice AS cpu_core_1, l_discount AS cpu_core_2, l_tax AS cpu_core_3,
           (l_quantity + l_extendedprice + l_discount + l_tax) / 4 AS cpu_mean
    FROM lineitem)
"""

_MEMORY = """
m AS (
    SELECT CAST(o_custkey % 5 AS VARCHAR) AS pid, o_orderdate AS "timestamp", o_orderkey * 4096 AS total,
           o_orderkey * 1024 AS available, o_orderkey * 3072 AS used, round(o_totalprice) / 10 AS percent,
           o_custkey * 7 AS free, o_custkey * 11 AS active, o_custkey * 13 AS inactive, o_custkey AS buffers,
           o_orderkey AS cached
    FROM orders)
"""

_FRAMES = """
fr AS (
    SELECT CAST(label % 3 AS VARCHAR) AS pid, label AS animal, CAST(vec_id AS INTEGER) AS img,
           list_transform(embedding, lambda x: CAST((CAST(x AS DOUBLE) + 1) * 2000 AS FLOAT)) AS pixels
    FROM embeddings)
"""

_CLIPPED = "list_transform(pixels, lambda x: CASE WHEN x >= 1950 THEN CAST(1950 AS FLOAT) ELSE x END)"
_SCALED = "list_transform({}, lambda x: CAST(CAST(x AS DOUBLE) / 1950 AS FLOAT))"
_TRIPLED = "flatten(list_transform({}, lambda x: [x, x, x]))"


def _sums(pixels: str) -> str:
    """Size, sum and position-weighted sum of each frame's pixels."""
    return f"""
    WITH {_FRAMES}, done AS (SELECT img, {pixels} AS px FROM fr),
    long AS (SELECT img, CAST(unnest(px) AS DOUBLE) AS x, generate_subscripts(px, 1) AS k FROM done)
    SELECT img, CAST(count(*) AS INTEGER) AS size, round(sum(x), 4) AS total, round(sum(x * k), 2) AS placed
    FROM long GROUP BY img
    """


def _resized(pixels: str, fit: int = 12, left: int = 2, width: int = 16) -> str:
    """8 x 8 frames enlarged to ``fit`` x ``fit``, from column ``left`` of a target that is ``fit`` high."""
    return f"""
    src AS (SELECT pid, animal, img, {pixels} AS px FROM fr),
    places AS (
        SELECT i, j, (i + 0.5) * 8 / {fit} - 0.5 AS y, (j + 0.5) * 8 / {fit} - 0.5 AS x
        FROM range({fit}) AS t(i), range({fit}) AS u(j)),
    ends AS (
        SELECT i, j, y - floor(y) AS fy, x - floor(x) AS fx,
               CAST(greatest(0, floor(y)) AS INTEGER) AS y0, CAST(least(7, ceil(y)) AS INTEGER) AS y1,
               CAST(greatest(0, floor(x)) AS INTEGER) AS x0, CAST(least(7, ceil(x)) AS INTEGER) AS x1
        FROM places),
    four AS (
        SELECT pid, animal, img, i, j, fy, fx,
               CAST(px[y0 * 8 + x0 + 1] AS DOUBLE) AS a, CAST(px[y0 * 8 + x1 + 1] AS DOUBLE) AS b,
               CAST(px[y1 * 8 + x0 + 1] AS DOUBLE) AS c, CAST(px[y1 * 8 + x1 + 1] AS DOUBLE) AS d
        FROM src, ends),
    resized AS (
        SELECT pid, animal, img, i * {width} + j + {left} AS k,
               CAST(CAST(a + (b - a) * fx + ((c + (d - c) * fx) - (a + (b - a) * fx)) * fy AS FLOAT) AS DOUBLE) AS x
        FROM four)
    """


_ENHANCED = f"""
WITH {_FRAMES}, {_resized(_SCALED.format(_CLIPPED))}
SELECT img, 576 AS size, round(sum(3 * x), 4) AS total, round(sum(x * (9 * k + 6)), 2) AS placed FROM resized GROUP BY img
"""

_SCORED = f"""
WITH {_FRAMES}, long AS (
    SELECT pid, animal, img, CAST(unnest(pixels) AS DOUBLE) AS x, generate_subscripts(pixels, 1) - 1 AS k FROM fr)
SELECT pid, animal, img, round(CAST(CAST(sum(x * (k * 37 % 11 - 5) / 10.0) AS FLOAT) AS DOUBLE), 2) AS weight
FROM long GROUP BY pid, animal, img
"""


def _animal_scores(where: str, resized: str = _resized(_SCALED.format(_CLIPPED))) -> str:
    return f"""
    WITH {_FRAMES}, {resized},
    scored AS (
        SELECT pid, animal, img, CAST(CAST(sum(x * (k * 37 % 11 - 5) / 10.0) AS FLOAT) AS DOUBLE) AS weight
        FROM resized GROUP BY pid, animal, img)
    SELECT pid, animal, round(avg(weight), 4) AS mean_weight, count(*) AS scored_images
    FROM scored WHERE {where} GROUP BY pid, animal
    """


def _whole(sql: str) -> str:
    """The same over frames of whole numbers."""
    return sql.replace("CAST((CAST(x AS DOUBLE) + 1) * 2000 AS FLOAT)", "round(CAST((CAST(x AS DOUBLE) + 1) * 2000 AS FLOAT))")


_ELAPSED = """
e AS (
    SELECT CAST(user_id % 3 AS VARCHAR) AS pid, CAST(user_id AS INTEGER) AS animal, ts, event_id, value,
           epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS elapsed_us,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS img
    FROM events)
"""

_SESSIONS = f"""
opened AS (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY animal ORDER BY ts) <= {_GAP_US} THEN 0 ELSE 1 END AS o
    FROM e),
numbered AS (SELECT *, sum(o) OVER (PARTITION BY animal ORDER BY ts) AS session FROM opened)
"""


def _times(columns: str) -> str:
    return f'count(*) AS n, min("timestamp") AS first_ts, max("timestamp") AS last_ts, {columns}'


def _totals(*columns: str) -> str:
    digits = {"cpu_mean": 4, "Volt[V]": 4, "Current[A]": 5}
    return ", ".join(f'round(sum(CAST("{c}" AS DOUBLE)), {digits.get(c, 2)}) AS "{c}"' for c in columns)


_WIDE = """
w AS (
    SELECT event_type AS pid, ts AS "timestamp", event_id % 1000 + 0.5 AS "Time[S]",
           round(value * 100) / 10000 AS "Volt[V]", round(value * 100) / 100000 AS "Current[A]", value AS "Power[W]",
           round(value * 10) / 10 AS "Res[Ohm]", event_id AS "G0[mAh]", event_id * 5 AS "G0[mWh]",
           user_id AS "G1[mAh]", user_id * 5 AS "G1[mWh]", user_id % 50 - 25 AS "Temp[C]",
           event_id % 300 / 100 AS "D+[V]", user_id % 300 / 100 AS "D-[V]"
    FROM events)
"""

_RECORDS = """
rec AS (
    SELECT CAST(user_id % 3 AS VARCHAR) AS pid, event_id, CAST(i AS INTEGER) AS "Rec",
           round(value * 100) * i * 1e-4 AS "Volt", (round(value * 100) + i) * 1e-5 AS "Current"
    FROM events, range(1, 1441) AS t(i) WHERE i <= CASE WHEN event_id % 250 = 7 THEN 1440 ELSE user_id % 4 END)
"""

_MEMORY_COLUMNS = ("total", "available", "used", "percent", "free", "active", "inactive", "buffers", "cached")
_MEASURES = ("throughput_per_hour", "fps", "mean_latency_us")

_PASSAGES = f"""
        WITH {_ELAPSED}, {_SESSIONS}
        SELECT pid, animal, min(ts) AS session_start, max(ts) + to_microseconds({_GAP_US}) AS session_end,
               count(*) AS total_of_images, count(*) FILTER (WHERE value <= 100) AS suitable_images,
               round(avg(value) FILTER (WHERE value <= 100), 6) AS mean_weight
        FROM numbered GROUP BY pid, animal, session"""

CHECKS: dict[str, str] = {
    "animal_metrics": _ANIMALS,
    "report_roundtrip": _ANIMALS,
    "report_roundtrip_animals": f"""
        WITH {_IMAGES}
        SELECT pid, CAST(1 AS BIGINT) AS documents, 2 * count(DISTINCT animal) AS animals,
               count(DISTINCT animal) AS without_images, count(DISTINCT (animal, img)) AS images
        FROM f GROUP BY pid""",
    "compare_runs_unsettled": f"""
        WITH {_IMAGES}, settings AS (SELECT * FROM (VALUES ('0', 'batch'), ('2', 'single')) AS s(pid, strategy))
        SELECT m.pid, strategy, m.animals, m.collect_lead_time_us,
               CASE WHEN strategy IS NOT NULL THEN m.collect_lead_time_us - b.collect_lead_time_us END AS collect_lead_time_us_delta
        FROM rr m LEFT JOIN settings s USING (pid) LEFT JOIN rr b ON b.pid = '0'""",
    "run_metrics": f"""
        WITH {_IMAGES}
        SELECT * REPLACE (round(mean_latency_us, 6) AS mean_latency_us,
                          round(throughput_per_hour, 6) AS throughput_per_hour, round(fps, 6) AS fps) FROM rr""",
    "image_rows_with_metrics": f"""
        WITH {_IMAGES} SELECT * REPLACE (round(throughput_per_hour, 6) AS throughput_per_hour) FROM ir""",
    "compat_last_image": f"""
        WITH {_IMAGES}, last AS (
            SELECT pid, animal, epoch_us(final) - epoch_us(started) AS dur_us,
                   row_number() OVER (PARTITION BY pid, animal ORDER BY img DESC) AS place
            FROM f)
        SELECT pid, animal, a.total_of_images AS image_rows, a.total_of_images * last.dur_us AS processing_delay_us
        FROM a JOIN last USING (pid, animal) WHERE place = 1""",
    "model_load_time": "SELECT CAST(user_id % 3 AS VARCHAR) AS pid, max((5 + user_id % 3) * 1000000) AS load_model_dur_us "
    "FROM events GROUP BY 1",
    "compare_runs": f"""
        WITH {_IMAGES}, settings AS (
            SELECT * FROM (VALUES ('0', 'batch', 10.0, 3.0, 3.0), ('1', 'batch', 5.0, 3.0, 3.0), ('2', 'single', 5.0, 3.0, 2.0))
                AS s(pid, strategy, passage_time, arrival_time, "window"))
        SELECT s.pid, strategy, CAST(passage_time AS DOUBLE) AS passage_time, CAST(arrival_time AS DOUBLE) AS arrival_time,
               CAST("window" AS DOUBLE) AS "window", m.animals, m.collect_lead_time_us, m.total_processing_delay_us,
               {", ".join(f"round(m.{c}, 6) AS {c}" for c in _MEASURES)},
               m.collect_lead_time_us - b.collect_lead_time_us AS collect_lead_time_us_delta,
               m.total_processing_delay_us - b.total_processing_delay_us AS total_processing_delay_us_delta,
               {", ".join(f"round(m.{c} - b.{c}, 6) AS {c}_delta" for c in _MEASURES)}
        FROM settings s JOIN rr m USING (pid) LEFT JOIN rr b ON b.pid = '0'""",
    "iso_times": """
        SELECT user_id, min(ts) AS first_ts, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last_text,
               CAST(0 AS BIGINT) AS drift_us, count(*) AS parsed
        FROM events GROUP BY user_id""",
    "run_energy": _ENERGY,
    "energy_stream_totals": _ENERGY,
    "power_interval_rows": f"""
        WITH {_POWER}
        SELECT pid, event_id, dt_hours, energy_wh FROM pe""",
    "describe_reports": f"WITH {_IMAGES} "
    + _describe(
        "ir",
        {
            c: c
            for c in (
                "weight_prediction_dur_us",
                "lead_time_us",
                "processing_delay_us",
                "latency_us",
                "throughput_per_hour",
            )
        },
    ),
    "describe_animals": f"WITH {_IMAGES} "
    + _describe("a", {c: c for c in ("lead_time_us", "processing_delay_us", "latency_us")}),
    "describe_power": f"WITH {_POWER} "
    + _describe(
        "pe",
        {
            "power_w": "power_w",
            "dt_hours": "dt_hours",
            "energy_wh": "energy_wh",
            "timestamp": "epoch_us(\"timestamp\") - epoch_us(TIMESTAMP '2024-01-01')",
        },
        ("timestamp",),
    ),
    "describe_cpu": f"WITH {_CPU} "
    + _describe("c", {c: c for c in ("cpu_core_0", "cpu_core_1", "cpu_core_2", "cpu_core_3", "cpu_mean")}),
    "describe_memory": f"WITH {_MEMORY} " + _describe("m", {c: c for c in _MEMORY_COLUMNS}),
    "frame_table_roundtrip": """
        SELECT CAST(label % 3 AS VARCHAR) AS pid, label AS animal, count(*) AS frames,
               TIMESTAMP '2024-01-01' + to_seconds(min(vec_id)) AS first_ts, CAST(sum(len(embedding)) AS BIGINT) AS pixels
        FROM embeddings GROUP BY label""",
    "core_mean": f"""
        WITH {_CPU}
        SELECT pid, round(avg(cpu_mean), 6) AS mean, round(min(cpu_mean), 6) AS low, round(max(cpu_mean), 6) AS high
        FROM c GROUP BY pid""",
    "histogram_cpu": f"""
        WITH {_CPU}, s AS (
            SELECT pid, min(cpu_core_1) AS low, (max(cpu_core_1) - min(cpu_core_1)) / 20 AS width FROM c GROUP BY pid),
        n AS (
            SELECT pid, least(19, CAST(floor((cpu_core_1 - low) / width) AS INTEGER)) AS bin, count(*) AS n
            FROM c JOIN s USING (pid) GROUP BY ALL)
        SELECT s.pid, CAST(b.bin AS INTEGER) AS bin, round(low + b.bin * width, 4) AS bin_low,
               round(low + (b.bin + 1) * width, 4) AS bin_high, coalesce(n.n, 0) AS n
        FROM s CROSS JOIN range(20) AS b(bin) LEFT JOIN n ON n.pid = s.pid AND n.bin = b.bin""",
    "kde_power": """
        WITH v AS (SELECT CAST(user_id % 3 AS VARCHAR) AS pid, value FROM events),
        s AS (
            SELECT pid, count(*) AS n, min(value) AS low, (max(value) - min(value)) / 199 AS step,
                   stddev_samp(value) * pow(count(*), -0.2) AS h
            FROM v GROUP BY pid)
        SELECT s.pid, CAST(g.k AS INTEGER) AS point, round(low + g.k * step, 8) AS x,
               round(sum(exp(-0.5 * pow((low + g.k * step - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8)
                   AS density
        FROM s JOIN v USING (pid), range(200) AS g(k) GROUP BY s.pid, g.k, low, step""",
    "kde_power_binned": """
        WITH v AS (SELECT CAST(user_id % 3 AS VARCHAR) AS pid, value FROM events),
        s AS (
            SELECT pid, count(*) AS n, min(value) AS low, max(value) AS high, (max(value) - min(value)) / 199 AS step,
                   stddev_samp(value) * pow(count(*), -0.2) AS h
            FROM v GROUP BY pid),
        p AS (SELECT s.pid, low, high, (value - low) / (high - low) * 511 AS place FROM v JOIN s USING (pid)),
        q AS (SELECT *, least(floor(place), 510) AS below FROM p),
        b AS (
            SELECT pid, low + bin * (high - low) / 511 AS value, sum(w) AS w FROM (
                SELECT pid, low, high, below AS bin, 1 - (place - below) AS w FROM q
                UNION ALL SELECT pid, low, high, below + 1, place - below FROM q)
            GROUP BY pid, low, high, bin)
        SELECT s.pid, CAST(g.k AS INTEGER) AS point, round(low + g.k * step, 8) AS x,
               round(sum(w * exp(-0.5 * pow((low + g.k * step - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8)
                   AS density
        FROM s JOIN b USING (pid), range(200) AS g(k) GROUP BY s.pid, g.k, low, step""",
    "line_series_cpu": f"""
        WITH {_CPU}
        SELECT pid, "timestamp", round(avg(cpu_core_1), 6) AS mean FROM c GROUP BY pid, "timestamp" """,
    "telemetry_windows": """
        SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS readings,
               round(avg(value), 6) AS mean
        FROM events GROUP BY 1""",
    "telemetry_stream_windows": """
        SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS readings,
               round(avg(value), 6) AS mean
        FROM events GROUP BY 1""",
    "first_rows": """
        SELECT CAST(user_id AS VARCHAR) AS pid, ts AS "timestamp", value AS "Power[W]", event_id
        FROM events ORDER BY ts, event_id LIMIT 5""",
    "first_rows_per_run": """
        SELECT CAST(user_id AS VARCHAR) AS pid, event_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place
        FROM events QUALIFY place <= 5""",
    "frame_ordinals": f"""
        WITH {_ELAPSED} SELECT pid, animal, event_id, img, round(elapsed_us / 1e6, 6) AS elapsed FROM e""",
    "suitable_frames": f"""
        WITH {_ELAPSED}
        SELECT pid, animal, count(*) AS frames, min_by(event_id, ts) AS first_frame
        FROM e WHERE elapsed_us <= {_WINDOW_US} AND elapsed_us < {_PASSAGE_US} GROUP BY pid, animal""",
    "frame_counters_fps": f"""
        WITH {_ELAPSED}
        SELECT pid, count(*) AS total_of_images, count(*) FILTER (WHERE elapsed_us <= {_WINDOW_US}) AS suitable_images,
               epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us,
               round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 8) AS captured_per_second
        FROM e WHERE elapsed_us < {_PASSAGE_US} GROUP BY pid""",
    "clip_frames": _sums(_CLIPPED),
    "scale_frames": _sums(_SCALED.format("pixels")),
    "replicate_frames": _sums(_TRIPLED.format("pixels")),
    "resize_frames": f"""
        WITH {_FRAMES}, {_resized("pixels")}
        SELECT img, 192 AS size, round(sum(x), 4) AS total, round(sum(x * (k + 1)), 2) AS placed FROM resized GROUP BY img""",
    "enhance_frames": _ENHANCED,
    "enhance_frames_builtin": _ENHANCED,
    "transform_chain": _sums(
        f"flatten(list_transform(list_transform({_CLIPPED}, lambda x: CAST(1950 - x AS FLOAT)), lambda x: [x, x]))"
    ),
    "score_frames": _SCORED,
    "score_frames_singly": _SCORED,
    "score_animals": _animal_scores("true"),
    "score_animals_default_shape": _animal_scores("true", _resized(_SCALED.format(_CLIPPED), 300, 0, 300)),
    "score_stream": _animal_scores(
        "img IN (SELECT vec_id FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) * 10 + 5 <= 5)"
    ),
    "passage_sessions": f"""
        WITH {_ELAPSED}, {_SESSIONS}
        SELECT pid, animal, min(ts) AS session_start, max(ts) AS session_last, count(*) AS frames,
               round(avg(value), 6) AS mean_weight
        FROM numbered GROUP BY pid, animal, session""",
    "passage_stream": _PASSAGES,
    "telemetry_stream_by_run": """
        SELECT CAST(user_id AS VARCHAR) AS pid, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start,
               count(*) AS readings, round(avg(value), 6) AS mean
        FROM events GROUP BY 1, 2""",
    "passage_stream_by_run": _PASSAGES,
    "raw_frame_stream": f"""
        WITH raw AS (
            SELECT label, vec_id, vec_id - min(vec_id) OVER (PARTITION BY label) AS elapsed FROM embeddings),
        counted AS (
            SELECT CAST(label % 3 AS VARCHAR) AS pid, label AS animal, count(*) AS total_of_images,
                   count(*) FILTER (WHERE elapsed <= 200) AS suitable_images,
                   TIMESTAMP '2024-01-01' + to_seconds(min(vec_id)) AS first_image_capture_time,
                   TIMESTAMP '2024-01-01' + to_seconds(max(vec_id)) AS last_image_capture_time
            FROM raw WHERE elapsed < 400 GROUP BY label),
        weighed AS ({_animal_scores("img IN (SELECT vec_id FROM raw WHERE elapsed <= 200)")})
        SELECT counted.*, mean_weight, scored_images FROM counted JOIN weighed USING (pid, animal)""",
    "energy_stream_any_order": _ENERGY,
    "report_files": _ANIMALS,
    "report_file_images": f"""
        WITH {_IMAGES}
        SELECT pid, animal, count(*) AS images, min(img) AS first_img, min(started) AS first_start, max(final) AS last_final,
               any_value(total_of_images) AS total_of_images, any_value(suitable_images) AS suitable_images
        FROM f JOIN g USING (pid, animal) GROUP BY pid, animal""",
    "score_packed_frames": _whole(_animal_scores("true")),
    "resize_packed_frames": _whole(f"""
        WITH {_FRAMES}, {_resized("list_transform(pixels, lambda x: CAST(x * CAST(1.0 / 65535 AS FLOAT) AS FLOAT))")}
        SELECT img, 192 AS size, round(sum(x), 4) AS total, round(sum(x * (k + 1)), 2) AS placed FROM resized GROUP BY img"""),
    "cpu_log_roundtrip": f"""
        WITH {_CPU}
        SELECT pid, {_times(_totals("cpu_core_0", "cpu_core_1", "cpu_core_2", "cpu_core_3", "cpu_mean"))} FROM c GROUP BY pid""",
    "memory_log_roundtrip": f"""
        WITH {_MEMORY}
        SELECT pid, {_times(_totals(*_MEMORY_COLUMNS))} FROM m GROUP BY pid""",
    "gpu_log_roundtrip": """
        SELECT CAST(user_id % 4 AS VARCHAR) AS pid, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts,
               CAST(sum(length(event_type)) AS BIGINT) AS gpu_usage,
               CAST(sum(length('gpu=' || user_id)) AS BIGINT) AS gpu_memor,
               CAST(sum(length('volt=' || event_id)) AS BIGINT) AS gpu_volts,
               CAST(sum(length(props)) AS BIGINT) AS gpu_tempr, max('volt=' || event_id) AS largest
        FROM events GROUP BY 1""",
    "power_log_roundtrip": f"""
        WITH {_WIDE}
        SELECT pid, {_times(_totals("Time[S]", "Volt[V]", "Current[A]", "Power[W]", "Res[Ohm]", "G0[mAh]", "G0[mWh]",
                                    "G1[mAh]", "G1[mWh]", "Temp[C]", "D+[V]", "D-[V]"))}
        FROM w GROUP BY pid""",
    "narrow_power_log_roundtrip": f"""
        WITH {_WIDE}
        SELECT pid, {_times(_totals("Volt[V]", "Current[A]", "Power[W]"))}, count(*) AS narrow_rows FROM w GROUP BY pid""",
    "format_power_rows": f"""
        WITH {_WIDE}
        SELECT pid, strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') AS "Datetime", printf('%5.1f', "Time[S]") AS "Time[S]",
               printf('%07.4f', "Volt[V]") AS "Volt[V]", printf('%07.5f', "Current[A]") AS "Current[A]",
               printf('%07.4f', "Power[W]") AS "Power[W]", printf('%5.2f', "Res[Ohm]") AS "Res[Ohm]",
               printf('%6d', "G0[mAh]") AS "G0[mAh]", printf('%6d', "G0[mWh]") AS "G0[mWh]",
               printf('%6d', "G1[mAh]") AS "G1[mAh]", printf('%6d', "G1[mWh]") AS "G1[mWh]",
               printf('%+3d', "Temp[C]") AS "Temp[C]", printf('%4.2f', "D+[V]") AS "D+[V]", printf('%4.2f', "D-[V]") AS "D-[V]"
        FROM w""",
    "meter_packets": """
        SELECT event_id, 'MTR1' AS "Name", '1.14' AS "Version", event_id AS "SN", user_id AS "Runs",
               round(round(value * 100) * 1e-4, 5) AS "Volt", round(round(value * 100) * 1e-5, 5) AS "Current",
               round(round(value * 100) * 1e-4, 5) AS "Power", round(round(value * 100) * 1e-1, 5) AS "Resistance",
               event_id AS "G0_mAh", event_id * 5 AS "G0_mWh", user_id AS "G1_mAh", user_id * 5 AS "G1_mWh",
               CASE WHEN user_id % 2 = 1 THEN -(user_id % 50) ELSE user_id % 50 END AS "Temp",
               round(event_id % 300 * 1e-2, 5) AS "D_plus", round(user_id % 300 * 1e-2, 5) AS "D_minus"
        FROM events WHERE event_type NOT IN ('view', 'error')""",
    "meter_rejects": """
        SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 100 ELSE 192 END AS bytes
        FROM events WHERE event_type IN ('view', 'error')""",
    "meter_recordings": f"""
        WITH {_RECORDS}
        SELECT * REPLACE (round("Volt", 5) AS "Volt", round("Current", 5) AS "Current") FROM rec""",
    "format_recording_rows": f"""
        WITH {_RECORDS}
        SELECT pid, printf('%4d', "Rec") AS "Rec", printf('%07.4f', "Volt") AS "Volt[V]",
               printf('%07.5f', "Current") AS "Current[A]" FROM rec""",
    "recording_log_roundtrip": f"""
        WITH {_RECORDS}
        SELECT pid, CAST("Rec" AS BIGINT) AS "Rec", count(*) AS n, round(sum("Volt"), 4) AS "Volt[V]",
               round(sum("Current"), 5) AS "Current[A]"
        FROM rec GROUP BY pid, "Rec" """,
}
