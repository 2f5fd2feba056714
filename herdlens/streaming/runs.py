"""Streams in which every run keeps its own time.

A watermark is one instant for a whole stream, so a run that is uploaded after a newer one would count as late from its
first row on. Here progress is part of the state of each key: a window, a passage or a selection is final when the
newest time *of its own key*, less ``delay``, has passed it. Rows that come after that are not dropped: they come out
with ``late`` set, to be kept in a side table.

A key ends with a row of ``tables.write_ends``, or, with ``idle``, when nothing has come for so long (a processing-time
timer). What stays of an ended key is one small row, which goes after ``keep`` where timers are used.

Input is folded inside each Arrow batch before it is shuffled (windows and passages to sums, frames that cannot be
suitable to their times), so a key with a large share of all rows sends few. Start these streams with ``run_table``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from herdlens.functions.clock import SECOND_US, epoch_micros, micros
from herdlens.functions.values import nan_to_null
from herdlens.operators.scoring import MakePredict, score_enhanced
from herdlens.operators.selection import PASSAGE
from herdlens.streaming.tables import END, append_table

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_END_US = int(pd.Timestamp(END).value // 1000)
_NEVER = -(1 << 62)


@contextmanager
def _keyed_state(spark: SparkSession):
    """The state store that keyed processors need, for a stream that starts inside; the session is left as it was."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_table(results: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Results of this module as a table, ``late`` rows included."""
    with _keyed_state(results.sparkSession):
        return append_table(results, path, checkpoint, trigger)


class _Keyed(StatefulProcessor):
    """What the processors share: progress of the key, and its end by a row or by a timer."""

    def __init__(self, delay: int, idle: int | None, keep_ms: int):
        self.delay, self.idle, self.keep_ms = delay, idle, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "newest bigint, timer bigint")
        # Outlives the key: what is final up to here.
        self.closed = handle.getValueState("closed", "us bigint", self.keep_ms if self.idle else None)

    # Every call to the state crosses to the JVM and back, which is most of what a small key costs.
    def newest(self) -> tuple[int, int]:
        return self.progress.get() or (_NEVER, 0)

    def closed_to(self) -> int:
        return (self.closed.get() or (_NEVER,))[0]

    def advance(self, newest: int, timers) -> None:
        """Keep the progress, and a timer that fires when the key has been idle."""
        timer = 0
        if self.idle:
            _, timer = self.newest()
            if timer:
                self.handle.deleteTimer(timer)
            timer = timers.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(timer)
        self.progress.update((newest, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        made = self.end(key)
        if len(made):
            yield made
        self.progress.clear()

    def end(self, key) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _keyed(folded: DataFrame, keys: Sequence[str], processor: _Keyed, schema: T.StructType) -> DataFrame:
    mode = "ProcessingTime" if processor.idle else "None"
    return folded.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", mode)


def _processing(idle: str | None, keep: str) -> tuple[int | None, int]:
    return (micros(idle) // 1000 if idle else None), micros(keep) // 1000


def _schema(source: DataFrame, keys: Sequence[str], ddl: str) -> T.StructType:
    more = T._parse_datatype_string(ddl)
    return T.StructType([source.schema[k] for k in keys] + more.fields)


def _timed(rows: DataFrame, timestamp: str, *columns) -> DataFrame:
    return rows.where(F.col(timestamp).isNotNull()).select(*columns)


def _naive(us: np.ndarray | list) -> pd.Series:
    return pd.Series(np.asarray(us, dtype="datetime64[us]"))


# --- utilisation ------------------------------------------------------------------------------------


#: Windows of one state entry.
_BLOCK = 256
_WINDOW = np.dtype([("start", "<i8"), ("readings", "<i8"), ("total", "<f8")])


class _Windows(_Keyed):
    """Open windows are kept in blocks of neighbours: a key has a state entry for each block, not for each window."""

    def __init__(self, keys: Sequence[str], every: int, *common):
        super().__init__(*common)
        self.keys, self.every = list(keys), every

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "block bigint", "windows binary")

    def _block(self, start: int) -> int:
        return start // (self.every * _BLOCK)

    @staticmethod
    def _pack(windows: dict[int, tuple[int, float]]) -> bytes:
        rows = np.array([(s, *v) for s, v in windows.items()], _WINDOW)
        return rows.tobytes()

    @staticmethod
    def _unpack(packed: bytes) -> dict[int, tuple[int, float]]:
        return {s: (n, total) for s, n, total in np.frombuffer(bytes(packed), _WINDOW).tolist()}

    def _rows(self, key, found: list[tuple[int, int, float]], late: bool) -> pd.DataFrame:
        out = pd.DataFrame({k: [v] * len(found) for k, v in zip(self.keys, key, strict=True)}, dtype=object)
        out["window_start"] = _naive([f[0] for f in found])
        out["readings"] = [f[1] for f in found]
        out["mean"] = pd.Series([f[2] / f[1] if f[1] else None for f in found], dtype=object)
        out["late"] = late
        return out

    def _close(self, key, to: int | None) -> pd.DataFrame:
        """Windows that end by ``to``, or all, leave the state."""
        done = []
        for (block,), (packed,) in list(self.open.iterator()):
            windows = self._unpack(packed)
            over = [s for s in windows if to is None or s + self.every <= to]
            done += [(s, *windows.pop(s)) for s in over]
            if over and windows:
                self.open.updateValue((block,), (self._pack(windows),))
            elif to is not None and over:
                self.open.removeKey((block,))
        if to is None:
            self.open.clear()
        if done:
            self.closed.update((max(self.closed_to(), max(d[0] for d in done) + self.every),))
        return self._rows(key, done, False)

    def end(self, key) -> pd.DataFrame:
        return self._close(key, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (newest, _), closed = self.newest(), self.closed_to()
        before, late, ended, changed = newest, [], False, {}
        for pdf in rows:
            for start, top, readings, total in zip(pdf["start"].tolist(), pdf["newest"].tolist(), pdf["readings"].tolist(), pdf["total"].tolist(), strict=True):
                if top >= _END_US:
                    ended = True
                    continue
                newest = max(newest, top)
                if start + self.every <= closed:
                    late.append((start, readings, total))
                    continue
                block = self._block(start)
                if block not in changed:
                    packed = self.open.getValue((block,))
                    changed[block] = self._unpack(packed[0]) if packed else {}
                n, sums = changed[block].get(start, (0, 0.0))
                changed[block][start] = (n + readings, sums + total)
        for block, windows in changed.items():
            self.open.updateValue((block,), (self._pack(windows),))
        if late:
            yield self._rows(key, late, True)
        if ended:
            yield self.end(key)
            if self.idle and self.newest()[1]:
                self.handle.deleteTimer(self.newest()[1])
            self.progress.clear()
            return
        self.advance(newest, timerValues)
        to = newest - self.delay
        if before == _NEVER:  # a new key has no windows but these
            due = any(s + self.every <= to for windows in changed.values() for s in windows)
        else:
            due = to // self.every > (before - self.delay) // self.every
        if due:
            made = self._close(key, to)
            if len(made):
                yield made


def _plain(value):
    return value.item() if hasattr(value, "item") else value


def utilisation_by_run(
    rows: DataFrame, value: str, every: str, delay: str, keys: Sequence[str] = ("pid",), timestamp: str = "timestamp", idle: str | None = None, keep: str = "30 days"
) -> DataFrame:
    """``keys, window_start, readings, mean, late`` of tumbling windows, each final by the time of its own run.

    The rows that are not late are those of ``telemetry.utilisation`` over the same input, in whatever order runs come.
    """
    width, keys = micros(every), list(keys)
    narrow = _timed(rows, timestamp, *keys, epoch_micros(timestamp).alias("us"), nan_to_null(F.col(value).cast("double")).alias("v"))
    folded = T.StructType([narrow.schema[k] for k in keys] + T._parse_datatype_string("start bigint, newest bigint, readings bigint, total double").fields)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["start"] = pdf["us"] // width * width
            groups = pdf.groupby([*keys, "start"], dropna=False, sort=False)
            made = groups.agg(newest=("us", "max"), readings=("v", "count"), total=("v", "sum")).reset_index()
            yield made[[*keys, "start", "newest", "readings", "total"]]

    out = _schema(narrow, keys, "window_start timestamp_ntz, readings bigint, mean double, late boolean")
    return _keyed(narrow.mapInPandas(fold, folded), keys, _Windows(keys, width, micros(delay), *_processing(idle, keep)), out)


# --- passages by gaps -------------------------------------------------------------------------------


class _Sessions(_Keyed):
    def __init__(self, keys: Sequence[str], gap: int, *common):
        super().__init__(*common)
        self.keys, self.gap = list(keys), gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getListState("open", "first bigint, last bigint, total bigint, suitable bigint, weight double, weighed bigint")

    def _rows(self, key, found: list[tuple], late: bool) -> pd.DataFrame:
        out = pd.DataFrame({k: [v] * len(found) for k, v in zip(self.keys, key, strict=True)}, dtype=object)
        out["session_start"], out["session_end"] = _naive([f[0] for f in found]), _naive([f[1] + self.gap for f in found])
        out["total_of_images"], out["suitable_images"] = [f[2] for f in found], [f[3] for f in found]
        out["mean_weight"] = pd.Series([f[4] / f[5] if f[5] else None for f in found], dtype=object)
        out["late"] = late
        return out

    def _known(self) -> list[tuple]:
        return [tuple(map(_plain, r)) for r in self.open.get()]

    def end(self, key) -> pd.DataFrame:
        return self._over(key, self._known())

    def _over(self, key, done: list[tuple]) -> pd.DataFrame:
        self.open.clear()
        if done:
            self.closed.update((max(self.closed_to(), max(d[1] for d in done) + self.gap),))
        return self._rows(key, done, False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (newest, _), closed = self.newest(), self.closed_to()
        known = self._known()
        parts, late, ended = list(known), [], False
        for pdf in rows:
            for part in zip(*(pdf[c].tolist() for c in ("first", "last", "total", "suitable", "weight", "weighed")), strict=True):
                if part[1] >= _END_US:
                    ended = True
                elif part[0] <= closed:
                    late.append(part)
                else:
                    newest = max(newest, part[1])
                    parts.append(part)
        merged: list[tuple] = []
        for part in sorted(parts):
            if merged and part[0] - merged[-1][1] <= self.gap:
                m = merged[-1]
                merged[-1] = (m[0], max(m[1], part[1]), *(a + b for a, b in zip(m[2:], part[2:], strict=True)))
            else:
                merged.append(part)
        over = [m for m in merged if m[1] + self.gap <= newest - self.delay]
        still = merged[len(over) :]
        if still and not ended:
            self.open.put(still)
        elif known and not ended:
            self.open.clear()
        if over and not ended:
            self.closed.update((max(closed, over[-1][1] + self.gap),))
        if late:
            yield self._rows(key, late, True)
        if ended:
            yield self._over(key, merged)
            if self.idle and self.newest()[1]:
                self.handle.deleteTimer(self.newest()[1])
            self.progress.clear()
        else:
            if over:
                yield self._rows(key, over, False)
            self.advance(newest, timerValues)


def passages_by_run(
    frames: DataFrame, gap_seconds: float, delay: str, window: float, keys: Sequence[str] = PASSAGE, value: str = "weight", idle: str | None = None, keep: str = "30 days"
) -> DataFrame:
    """One row per passage, as ``frames.passage_weights`` gives, by the time of its own key, and ``late``.

    ``elapsed`` comes with the frames; ``selected_frames`` works it out.
    """
    gap, keys = int(gap_seconds * SECOND_US), list(keys)
    suitable = (F.col("elapsed") <= F.lit(float(window))).alias("fits")
    narrow = _timed(frames, "ts", *keys, epoch_micros("ts").alias("us"), suitable, nan_to_null(F.col(value).cast("double")).alias("v"))
    ddl = "first bigint, last bigint, total bigint, suitable bigint, weight double, weighed bigint"
    folded = T.StructType([narrow.schema[k] for k in keys] + T._parse_datatype_string(ddl).fields)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fits = pdf["fits"].eq(True)
            pdf["fits"], pdf["v"] = fits.astype("int64"), pdf["v"].where(fits)
            pdf = pdf.sort_values("us", kind="stable")
            pdf["part"] = (pdf.groupby(keys, dropna=False)["us"].diff().fillna(0) > gap).astype("int64")
            pdf["part"] = pdf.groupby(keys, dropna=False)["part"].cumsum()
            groups = pdf.groupby([*keys, "part"], dropna=False, sort=False)
            made = groups.agg(first=("us", "min"), last=("us", "max"), total=("us", "size"), suitable=("fits", "sum"), weight=("v", "sum"), weighed=("v", "count"))
            yield made.reset_index()[folded.names]

    ddl = "session_start timestamp_ntz, session_end timestamp_ntz, total_of_images bigint, suitable_images bigint, mean_weight double, late boolean"
    return _keyed(narrow.mapInPandas(fold, folded), keys, _Sessions(keys, gap, micros(delay), *_processing(idle, keep)), _schema(narrow, keys, ddl))


# --- selection from raw frames ----------------------------------------------------------------------


class _Starts(_Keyed):
    """State of one animal: when its passage began, counters, and the frames that came before that was certain."""

    def __init__(self, keys: Sequence[str], columns: Sequence[str], arrow: pa.Schema, passage: int, window: int, *common):
        super().__init__(*common)
        self.keys, self.columns, self.arrow = list(keys), list(columns), arrow
        self.passage, self.window = passage, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.passing = handle.getValueState("passing", "start bigint, settled boolean, total bigint, suitable bigint, last bigint")
        self.pending = handle.getListState("pending", "frames binary")

    def _pack(self, pdf: pd.DataFrame) -> bytes:
        sink = io.BytesIO()
        table = pa.Table.from_pandas(pdf[self.arrow.names], schema=self.arrow, preserve_index=False)
        with pa.ipc.new_stream(sink, self.arrow) as writer:
            writer.write_table(table)
        return sink.getvalue()

    def _unpack(self) -> list[pd.DataFrame]:
        blobs = [r[0] for r in self.pending.get()] if self.pending.exists() else []
        return [pa.ipc.open_stream(b).read_all().to_pandas() for b in blobs]

    def _out(self, key, pdf: pd.DataFrame, start: int | None, late: bool = False) -> pd.DataFrame:
        out = pdf[self.columns].copy()
        for k, v in zip(self.keys, key, strict=True):
            out[k] = pd.Series([v] * len(out), index=out.index, dtype=object)
        out["ts"] = pdf["us"].to_numpy().astype("datetime64[us]")
        out["elapsed"] = None if start is None else (pdf["us"] - start) / SECOND_US
        out["total_of_images"] = out["suitable_images"] = out["first_ts"] = out["last_ts"] = None
        out["late"] = late
        return out

    def _count(self, key, pdf: pd.DataFrame, state: list) -> pd.DataFrame:
        """Count the frames within the horizon; those that are suitable come out."""
        elapsed = pdf["us"] - state[0]
        within = elapsed < self.passage
        state[2] += int(within.sum())
        if within.any():
            state[4] = max(state[4], int(pdf["us"][within].max()))
        chosen = pdf[within & (elapsed <= self.window)]
        state[3] += len(chosen)
        return self._out(key, chosen, state[0])

    def _over(self, key, state: list) -> pd.DataFrame:
        """The passage's own row: counters and times, no frame."""
        row = pd.DataFrame({c: pd.Series([None], dtype=object) for c in self.columns})
        row["us"] = state[0]
        out = self._out(key, row, None)
        out["total_of_images"], out["suitable_images"] = state[2], state[3]
        out["first_ts"], out["last_ts"] = _naive([state[0]]), _naive([state[4]])
        return out

    def _settle(self, key, state: list) -> Iterator[pd.DataFrame]:
        state[1] = True
        for pdf in self._unpack():
            yield self._count(key, pdf, state)
        self.pending.clear()

    def end(self, key) -> pd.DataFrame:
        if not self.passing.exists():
            return pd.DataFrame()
        state = list(map(_plain, self.passing.get()))
        made = [] if state[1] else list(self._settle(key, state))
        self.closed.update((state[0],))
        self.passing.clear()
        return pd.concat([m.astype(object) for m in (*made, self._over(key, state)) if len(m)], ignore_index=True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (newest, _), ended = self.newest(), False
        for pdf in rows:
            ended |= bool((pdf["us"] >= _END_US).any())
            pdf = pdf[pdf["us"] < _END_US]
            if not len(pdf):
                continue
            newest = max(newest, int(pdf["us"].max()))
            if self.closed.exists():  # the passage is over: frames within its horizon are late, others do not count
                late = pdf[(pdf["us"] < self.closed_to() + self.passage) & pdf["frame"]]
                if len(late):
                    yield self._out(key, late, None, True)
                continue
            state = list(map(_plain, self.passing.get())) if self.passing.exists() else [_END_US, False, 0, 0, _NEVER]
            if state[1]:
                late = pdf[(pdf["us"] < state[0]) & pdf["frame"]]
                if len(late):
                    yield self._out(key, late, None, True)
                yield self._count(key, pdf[(pdf["us"] >= state[0]) & pdf["frame"]], state)
            else:
                frames = pdf[pdf["frame"]]
                state[0] = min(state[0], int(pdf["us"].min()))
                sure = frames["us"] - state[0] > self.window
                if sure.any():
                    frames = frames.assign(pixels=frames["pixels"].mask(sure, None))
                self.pending.appendValue((self._pack(frames),))
                if newest >= state[0] + self.delay:
                    yield from self._settle(key, state)
            self.passing.update(tuple(state))
        if self.passing.exists() and (ended or newest >= _plain(self.passing.get()[0]) + self.passage + self.delay):
            yield self.end(key)
            ended = True
        if ended:
            if self.idle and self.newest()[1]:
                self.handle.deleteTimer(self.newest()[1])
            self.progress.clear()
        else:
            self.advance(newest, timerValues)


def selected_frames(
    frames: DataFrame, passage_time: float, window: float, delay: str, keys: Sequence[str] = PASSAGE, idle: str | None = None, keep: str = "30 days"
) -> DataFrame:
    """Raw frames, without ``elapsed``, to the suitable ones with it, and one row of counters for each passage.

    A passage begins with the first frame of its key. As frames may come out of order by ``delay``, the start is certain
    once the key has a frame so much later, and frames wait for that; then each suitable frame comes out as it comes
    in. When the horizon has passed (or the key ends) a row without pixels has total_of_images, suitable_images, first_ts
    and last_ts. Frames that are too late come out with ``late`` and no ``elapsed``. Columns besides the keys, ``ts``,
    ``h``, ``w`` and ``pixels`` are carried along.
    """
    keys = list(keys)
    columns = [c for c in frames.columns if c not in (*keys, "ts")]
    source = _timed(frames, "ts", *keys, *columns, epoch_micros("ts").alias("us"))
    folded = T.StructType([*source.schema.fields, T.StructField("frame", T.BooleanType())])
    passage, width = int(round(passage_time * SECOND_US)), int(round(window * SECOND_US))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The earliest frame here is no earlier than the start: what is too far from it gives its pixels up."""
        for pdf in batches:
            least = pdf["us"] - pdf.groupby(keys, dropna=False)["us"].transform("min")
            ends = pdf["us"] >= _END_US
            pdf["pixels"] = pdf["pixels"].mask((least > width) | ends, None)
            pdf["frame"] = ~ends
            far = (least >= passage) & ~ends
            # Beyond the horizon only the newest time counts.
            newest = pdf[far].loc[lambda x: x.groupby(keys, dropna=False)["us"].idxmax()].assign(frame=False) if far.any() else pdf[far]
            yield pd.concat([pdf[~far], newest])[folded.names] if len(newest) else pdf[~far][folded.names]

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType([f for f in folded.fields if f.name not in keys]))
    ddl = "ts timestamp_ntz, elapsed double, total_of_images bigint, suitable_images bigint, first_ts timestamp_ntz, last_ts timestamp_ntz, late boolean"
    out = T.StructType([source.schema[c] for c in (*columns, *keys)] + T._parse_datatype_string(ddl).fields)
    processor = _Starts(keys, columns, arrow, passage, width, micros(delay), *_processing(idle, keep))
    return _keyed(source.mapInPandas(fold, folded), keys, processor, out)


def scored_passages(
    frames: DataFrame, make_predict: MakePredict, passage_time: float, window: float, delay: str, max_value: float, shape: tuple[int, int], channels: int, **options
) -> DataFrame:
    """The whole loop on a stream of raw frames: passage start, horizon, selection, enhancement, scoring.

    The rows of ``selected_frames`` with ``weight`` in place of the pixels; ``passage_results`` sums the table up.
    """
    return score_enhanced(selected_frames(frames, passage_time, window, delay, **options), make_predict, max_value, shape, channels).drop("pixels")


def passage_results(scored: DataFrame, keys: Sequence[str] = PASSAGE) -> DataFrame:
    """One row per key of a table of ``scored_passages``: counters, times and mean weight."""
    kept = scored.where(~F.col("late"))
    return kept.groupBy(*keys).agg(
        F.max("total_of_images").alias("total_of_images"),
        F.max("suitable_images").alias("suitable_images"),
        F.min("first_ts").alias("first_image_capture_time"),
        F.max("last_ts").alias("last_image_capture_time"),
        F.avg("weight").alias("mean_weight"),
        F.count("weight").alias("scored_images"),
    )
