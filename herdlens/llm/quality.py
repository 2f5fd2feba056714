"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Each document becomes ``len(STATISTICS)`` numbers. A fixed random map of the standardised numbers approximates a
Gaussian kernel. Partitions sum their part of the normal equations, Spark adds the sums, and the driver solves one
small system. Raw scores of rows kept aside are counted in bins, all of them, and the bins are calibrated isotonically.

Cases: a null text counts as empty and an empty one gets the score of its statistics (all zero); equal texts get equal
scores; without labelled rows every score is 0.5; an empty table gives an empty result. Columns of the input named
like a result column are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.llm import common

STATISTICS = (
    "log_chars", "log_words", "word_length", "distinct_share", "top_share", "repeat_share", "upper_share", "capital_share", "digit_share",
    "space_share", "symbol_share", "loud_share", "bar_share", "comma_share", "stop_share", "lines_per_word", "repeat_lines", "longest_run",
    "short_share", "bracket_share",
)
FEATURES, GAMMA, RIDGE, BINS = 128, 0.05, 1e-2, 400
_UPPER = np.array([chr(b).isupper() for b in range(128)] + [False] * 128)
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,'-" for b in range(256)])
_BRACKET = np.array([b in b"<>{}[]()" for b in range(256)])


def statistics(text: str) -> list[float]:
    """The numbers of one whole text."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode(), np.uint8)
    n, size = len(words), len(raw)
    counts = Counter(words)
    lines = text.split("\n")
    run = longest = repeats = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        repeats += a == b
        longest = max(longest, run)
    by_byte = np.bincount(raw, minlength=256)
    return [
        np.log1p(size), np.log1p(n), size / n / 10, len(counts) / n, max(counts.values()) / n, (repeats - 1) / n, float(by_byte[_UPPER].sum()) / size,
        text.count(" ") and sum(map(str.istitle, words)) / n, float(by_byte[_DIGIT].sum()) / size, (size - sum(map(len, words))) / size, float(by_byte[_SYMBOL].sum()) / size,
        text.count("!") / n, text.count("|") / n, text.count(",") / n, text.count(".") / n, len(lines) / n, 1 - len(set(lines)) / len(lines),
        np.log(longest), sum(len(w) <= 2 for w in words) / n, float(by_byte[_BRACKET].sum()) / size,
    ]


def with_statistics(docs: DataFrame, text: str = "text", column: str = "__stats__") -> DataFrame:
    """``docs`` with the array of statistics; narrow."""
    kind = pa.list_(pa.float64())

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([statistics(t) for t in texts.to_pylist()], kind)]

    return common.append(docs, [T.StructField(column, T.ArrayType(T.DoubleType()))], text, compute)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weight: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.omega + self.phase) * np.sqrt(2 / self.omega.shape[1])
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight if self.weight is not None else np.full(len(stats), 0.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        level = np.interp(raw, self.knots, self.values) if len(self.knots) else np.clip(raw, 0, 1)
        # The ridge score breaks ties inside a flat step of the isotonic fit.
        return np.clip(0.98 * level + 0.02 * np.clip(raw, 0, 1), 0, 1)


def _stats_array(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    at = [F.col("__stats__")[i] for i in range(len(STATISTICS))]
    got = rows.agg(F.count("*"), *(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at)).first()
    k = len(STATISTICS)
    if not got[0]:
        return np.zeros(k), np.ones(k), 0
    return np.array(got[1 : k + 1], float), np.maximum(np.array(got[k + 1 :], float), 1e-6), int(got[0])


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sum of z z' and z y over all rows: each partition adds up its own, Spark adds up the partitions."""
    width = model.omega.shape[1] + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_stats_array(batch.column("__stats__")))
                total[:, :width] += z.T @ z
                total[:, width] += z.T @ batch.column("__label__").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["cell", "value"]
        )

    sums = rows.mapInArrow(part, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros(width * (width + 1))
    total[sums["cell"].to_numpy()] = sums["value"].to_numpy()
    total = total.reshape(width, width + 1)
    return total[:, :width], total[:, width]


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value``: pool adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def with_raw(stats: DataFrame, model: Model, column: str, calibrated: bool) -> DataFrame:
    """``stats`` with the ridge score or the calibrated one in place of the statistics."""
    kept = [c for c in stats.columns if c not in (column, "__stats__")]
    schema = T.StructType([stats.schema[c] for c in kept] + [T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _stats_array(batch.column("__stats__"))
                made = pa.array(model.score(x) if calibrated else model.raw(x), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [made], names=[*kept, column])

    return stats.mapInArrow(run, schema)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", features: int = FEATURES, seed: int = 3) -> Model:
    """Fit on every labelled row outside fold 0; fold 1 calibrates, folds 2 to 4 give the normal equations.

    ``stats`` has ``doc_id`` and the statistics, and is read several times: pass a written table.
    """
    known = labels.where(~common.held_out("doc_id") & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("__label__"))
    rows = stats.select("doc_id", "__stats__").join(known, "doc_id").withColumn("__fold__", common.fold("doc_id"))
    learn, aside = rows.where("__fold__ > 1"), rows.where("__fold__ = 1")
    mean, scale, count = _moments(learn)
    draw = np.random.default_rng(seed)
    omega = draw.normal(0, np.sqrt(2 * GAMMA), (len(STATISTICS), features))
    model = Model(mean, scale, omega, draw.uniform(0, 2 * np.pi, features))
    if not count:
        return model
    gram, moment = _normal_equations(learn.select("__stats__", "__label__"), model)
    model.weight = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), moment)
    raw: Column = F.least(F.greatest(F.floor((F.col("__raw__") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    bins = with_raw(aside.select("__label__", "__stats__"), model, "__raw__", False).groupBy(raw.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("__label__").alias("y"), F.avg("__raw__").alias("x")
    ).toPandas().sort_values("bin")
    if len(bins):
        n = bins["n"].to_numpy(float)
        model.knots = bins["x"].to_numpy(float)
        model.values = isotonic((bins["y"].to_numpy(float) * n + 0.5) / (n + 1), n)
    return model


def score(stats: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The columns beside the statistics, and the calibrated probability of class 1."""
    return with_raw(stats, model, column, True)
