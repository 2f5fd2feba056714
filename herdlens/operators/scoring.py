"""Scoring frames with a user's model, and the mean weight per animal.

``make_predict`` is called once per Python worker and returns ``predict(batch) -> (n,) or (n, 1)``. A frame whose
pixels are NULL, or are not as many as its sizes say, gets a NULL weight.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.operators.enhance import CHANNELS, MAX_VALUE, PACKED, SHAPE, enhance_stack, stacks, unpacked, whole_frames

#: Models that a Python worker keeps.
MODELS = 4
MakePredict = Callable[[], Callable[[np.ndarray], np.ndarray]]


def _worker_model(name: str, make_predict: MakePredict):
    """The model of this Python worker: made by its first task, used by all.

    Functions of this package travel by value, so the models hang on a module that stays. A worker serves tasks of
    several queries in turn; of MODELS models the one that was used last longest ago goes.
    """
    kept = vars(np).setdefault("_models_by_name", {})
    if name not in kept:
        while len(kept) >= MODELS:
            kept.pop(next(iter(kept)))
        kept[name] = make_predict()
    kept[name] = kept.pop(name)  # the newest is the last one
    return kept[name]


def score_frames(
    frames: DataFrame, make_predict: MakePredict, tensor_shape: list[int], batch_size: int = 64
) -> DataFrame:
    """Adds ``weight`` from the pixels as they are. ``batch_size=1`` scores frame by frame.

    Inference keeps no state across rows, so a batch need not hold one animal's frames: rows are scored
    where they lie, without a shuffle.
    """
    model = predict_batch_udf(
        make_predict, return_type=T.FloatType(), batch_size=batch_size, input_tensor_shapes=[tensor_shape]
    )
    return frames.withColumn("weight", model("pixels"))


def score_enhanced(
    frames: DataFrame,
    make_predict: MakePredict,
    max_value: float = MAX_VALUE,
    shape: tuple[int, int] = SHAPE,
    channels: int = CHANNELS,
    batch_size: int = 32,
    dtype: str = PACKED,
) -> DataFrame:
    """Enhance and score in one Arrow pass: raw pixels (or packed ones of ``dtype``) go in, only ``weight`` comes back."""

    name = uuid.uuid4().hex

    @F.pandas_udf("float")
    def weigh(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = _worker_model(name, make_predict)
        for raw, heights, widths in columns:
            weights = np.full(len(raw), np.nan, dtype=np.float32)
            for begin in range(0, len(raw), batch_size):
                pixels = unpacked(raw.to_numpy()[begin : begin + batch_size], dtype)
                sizes = heights.to_numpy()[begin : begin + batch_size], widths.to_numpy()[begin : begin + batch_size]
                good = whole_frames(pixels, *sizes)
                if not len(good):
                    continue
                h, w = (s[good].astype(np.int64) for s in sizes)
                inputs = np.empty((len(h), *shape), dtype=np.float32)
                for at, stack in stacks(list(pixels[good]), h, w):
                    inputs[at] = enhance_stack(stack, max_value, shape)
                # Equal channels: a view, not a copy.
                view = np.broadcast_to(inputs[..., None], (*inputs.shape, channels))
                weights[begin + good] = np.asarray(predict(view)).reshape(-1)
            bad = np.isnan(weights)
            yield pd.Series(np.where(bad, None, weights), dtype=object) if bad.any() else pd.Series(weights)

    return frames.withColumn("weight", weigh("pixels", "h", "w"))


def mean_weights(scored: DataFrame) -> DataFrame:
    """Mean predicted weight and number of scored frames per animal; NULL mean if none had a weight."""
    return scored.groupBy("pid", "animal").agg(
        F.avg("weight").alias("mean_weight"), F.count("weight").alias("scored_images")
    )
