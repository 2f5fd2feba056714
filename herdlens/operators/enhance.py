"""Frame enhancement over frame tables (``pixels array<float>, h int, w int``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.functions import pixels as px

# Fixed defaults of the enhancement chain.
MAX_VALUE = 1950
CHANNELS = 3
SHAPE = (300, 300)

Transform = Callable[[DataFrame], DataFrame]


def clip_frames(frames: DataFrame, max_value: float = MAX_VALUE) -> DataFrame:
    return frames.withColumn("pixels", px.clip_to_max(F.col("pixels"), max_value))


def scale_frames(frames: DataFrame, max_value: float = MAX_VALUE) -> DataFrame:
    return frames.withColumn("pixels", px.scale_by_max(F.col("pixels"), max_value))


def replicate_frames(frames: DataFrame, channels: int = CHANNELS) -> DataFrame:
    return frames.withColumn("pixels", px.replicate_channel(F.col("pixels"), channels))


def resize_frames(frames: DataFrame, shape: tuple[int, int] = SHAPE) -> DataFrame:
    """Built-in form, for small one-channel frames."""
    resized = px.resize_with_padding(F.col("pixels"), F.col("h"), F.col("w"), shape)
    # In two steps: named in one projection, the new sizes would be taken for the old inside the lambda.
    return frames.withColumn("pixels", resized).withColumns({"h": F.lit(shape[0]), "w": F.lit(shape[1])})


def chain(frames: DataFrame, *transforms: Transform) -> DataFrame:
    """Apply user transforms, each ``DataFrame -> DataFrame``, in order."""
    for transform in transforms:
        frames = frames.transform(transform)
    return frames


def enhance_small(
    frames: DataFrame, max_value: float = MAX_VALUE, shape: tuple[int, int] = SHAPE, channels: int = CHANNELS
) -> DataFrame:
    """Clip, scale, resize and replicate with built-in expressions only.

    Channels are equal, so they are replicated last: the resize then works on one channel.
    """
    return chain(
        frames,
        lambda f: clip_frames(f, max_value),
        lambda f: scale_frames(f, max_value),
        lambda f: resize_frames(f, shape),
        lambda f: replicate_frames(f, channels),
    )


def _axis(size: int, fitted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Source indices on both sides of each output position, and the blend between them."""
    at = (np.arange(fitted) + 0.5) * size / fitted - 0.5
    floor = np.floor(at)
    below = np.maximum(floor, 0).astype(np.int64)
    above = np.minimum(np.ceil(at), size - 1).astype(np.int64)
    return below, above, at - floor


def resize_stack(stack: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Resize with padding of an ``(n, h, w)`` stack; the sizes are worked out in single precision."""
    n, h, w = stack.shape
    single = np.float32
    ratio = max(single(w) / single(shape[1]), single(h) / single(shape[0]))
    exact = (single(h) / ratio, single(w) / ratio)
    fit_h, fit_w = (int(np.floor(e)) for e in exact)
    top, left = (max(0, int(np.floor((single(t) - e) / single(2)))) for t, e in zip(shape, exact))
    out = np.zeros((n, *shape), dtype=np.float32)
    y0, y1, fy = _axis(h, fit_h)
    x0, x1, fx = _axis(w, fit_w)
    # Frame by frame, so that the double-precision steps stay in the cache; blended in place.
    for frame, target in zip(stack, out):
        wide = frame[:, x0].astype(np.float64)
        wide += (frame[:, x1] - wide) * fx
        tall = wide[y0]
        tall += (wide[y1] - tall) * fy[:, None]
        target[top : top + fit_h, left : left + fit_w] = tall
    return out


def enhance_stack(stack: np.ndarray, max_value: float, shape: tuple[int, int]) -> np.ndarray:
    """Clip, scale and resize of an ``(n, h, w)`` stack; one channel, NaN kept."""
    limit = np.float32(max_value)
    scaled = np.minimum(stack, limit)  # NaN wins over the limit
    scaled /= limit
    return resize_stack(scaled, shape)


def stacks(rows: list[np.ndarray], heights: np.ndarray, widths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Frames grouped by size: positions in the input, and the stack."""
    sizes = np.stack([heights, widths], axis=1)
    for h, w in np.unique(sizes, axis=0):
        at = np.flatnonzero((heights == h) & (widths == w))
        yield at, np.stack([np.asarray(rows[i], dtype=np.float32) for i in at]).reshape(-1, h, w)


#: Pixels of a packed frame: unsigned 16-bit numbers, the lowest byte first.
PACKED = "<u2"


def unpacked(rows: np.ndarray, dtype: str = PACKED) -> np.ndarray:
    """Rows of pixels, where packed ones (bytes) become arrays of their numbers; a ragged buffer becomes NULL."""
    out, width = np.empty(len(rows), dtype=object), np.dtype(dtype).itemsize
    for i, r in enumerate(rows):
        packed = isinstance(r, (bytes, bytearray, memoryview))
        out[i] = r if not packed else np.frombuffer(r, dtype) if len(r) % width == 0 else None
    return out


def pack_frames(frames: DataFrame, dtype: str = PACKED) -> DataFrame:
    """Whole-number pixels as one buffer a frame (``binary``), half the bytes of floats; others cannot be packed and fail."""
    kind = np.dtype(dtype)

    @F.pandas_udf("binary")
    def pack(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            made = []
            for r in column:
                values = None if r is None else np.asarray(r)
                made.append(None if values is None else values.astype(kind).tobytes())
                if values is not None and not np.array_equal(values, values.astype(kind)):
                    raise ValueError(f"pixels that {kind.name} cannot hold")
            yield pd.Series(made, dtype=object)

    return frames.withColumn("pixels", pack("pixels"))


def whole_frames(rows: np.ndarray, heights: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Positions of the frames that have as many pixels as their sizes say; NULL or ragged ones are left out."""
    return np.array(
        [i for i, (r, h, w) in enumerate(zip(rows, heights, widths)) if r is not None and h == h and w == w and h * w == len(r) > 0],
        dtype=np.int64,
    )


def enhance_frames(
    frames: DataFrame,
    max_value: float = MAX_VALUE,
    shape: tuple[int, int] = SHAPE,
    channels: int = CHANNELS,
    frames_per_batch: int = 32,
    dtype: str = PACKED,
) -> DataFrame:
    """The same chain over Arrow batches with numpy, for full-size frames, packed ones (of ``dtype``) included.

    A NULL or ragged frame gets NULL pixels. Output batches are small, since one enhanced frame is about a megabyte. To
    score frames, use
    ``scoring.score_enhanced``, which never sends enhanced pixels back to Spark.
    """
    return _stacked(frames, lambda stack: enhance_stack(stack, max_value, shape), shape, channels, frames_per_batch, dtype)


def resize_packed_frames(
    frames: DataFrame, shape: tuple[int, int] = SHAPE, frames_per_batch: int = 32, dtype: str = PACKED
) -> DataFrame:
    """Resize with padding of integer frames as they are: numbers become the part they are of their type's maximum."""
    scale = np.float32(1.0 / np.iinfo(np.dtype(dtype)).max)
    return _stacked(frames, lambda stack: resize_stack(stack * scale, shape), shape, 1, frames_per_batch, dtype)


def _stacked(
    frames: DataFrame, step: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], channels: int, frames_per_batch: int, dtype: str
) -> DataFrame:
    """``step`` over stacks of equally large frames."""
    names = frames.columns
    fields = [f for f in frames.schema.fields if f.name not in ("pixels", "h", "w")]
    others = [f.name for f in fields]
    drawn = [T.StructField("pixels", T.ArrayType(T.FloatType())), *(T.StructField(c, T.IntegerType()) for c in "hw")]
    schema = T.StructType([*fields, *drawn])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, frames_per_batch):
                batch = whole.slice(begin, frames_per_batch)
                n = batch.num_rows
                heights, widths = (batch.column(c).to_numpy(zero_copy_only=False) for c in "hw")
                rows = unpacked(batch.column("pixels").to_numpy(zero_copy_only=False), dtype)
                good = whole_frames(rows, heights, widths)
                done = np.empty((len(good), *shape), dtype=np.float32)
                h, w = heights[good].astype(np.int64), widths[good].astype(np.int64)
                for at, stack in stacks(list(rows[good]), h, w) if len(good) else ():
                    done[at] = step(stack)
                flat = np.repeat(done.reshape(-1), channels)
                here = np.zeros(n, dtype=bool)
                here[good] = True
                ends = np.concatenate([[0], np.cumsum(here)]).astype(np.int32) * np.int32(shape[0] * shape[1] * channels)
                pixels = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(~here))
                sizes = [pa.array(np.full(n, s, dtype=np.int32)) for s in shape]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in others), pixels, *sizes], names=[*others, "pixels", "h", "w"]
                )

    return frames.mapInArrow(run, schema).select(*names)
