"""Embedding whitening by the leading principal components.

Vectors are taken on a grid: an entry c counts as the whole number ``floor(scale * c)``. The fit list holds each distinct
vector once. Tasks sum it and then its centred products, at most one matrix a task; Spark adds those up row by row,
and only the d x d covariance reaches the driver, which makes it tridiagonal by Householder reflections, brackets the
leading eigenvalues by Sturm counts, and finds their vectors by inverse iteration, where vectors of a cluster of
close eigenvalues are made orthogonal to each other. The components travel in the task closure, and every row is
projected where it lies.

Cases: rows whose vector is null, or holds null, NaN, an infinity or an entry whose grid value does not fit a long, are
left out, and so are vectors of another length than the most frequent one (of equally frequent ones the longest) and
those without entries; equal vectors share one place in the fit list, whatever their ids; null and repeated ids are
rows like any other; very long vectors cost d x d doubles a task and at the driver; there are as many components as
eigenvalues above rounding error, none if all vectors are equal, so such tables give no rows, like an empty one; extra
columns are left alone. ``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm.common import written

SCALE, COMPONENTS = 256, 4
#: Rows of doubles handled at once, in entries.
BLOCK_ENTRIES = 1 << 20
_EPS = np.finfo(np.float64).eps


class Model(NamedTuple):
    n: int  # distinct vectors
    sums: np.ndarray  # of the grid values, by dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one component a row
    trace: float
    identity_error: float


def on_grid(vectors: DataFrame, column: str, scale: int = SCALE) -> DataFrame:
    """Rows with a usable vector, and ``x``: its grid values as little-endian longs, one binary a row."""
    kept = [c for c in vectors.columns if c not in (column, "x")]
    source = vectors.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`").cast("array<double>"))
    fields = source.select(*kept).schema.add("x", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            good = np.flatnonzero(~lists.is_null().to_numpy(zero_copy_only=False))
            lists = lists.take(pa.array(good))
            entries = lists.flatten()
            value = np.floor(scale * entries.fill_null(np.nan).to_numpy(zero_copy_only=False))
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            with np.errstate(invalid="ignore"):
                bad = np.concatenate([np.zeros(1, np.int64), np.cumsum(~(np.abs(value) < 2.0**63))])
            usable = (bad[end] == bad[end - size]) & (size > 0)
            x = np.where(np.abs(value) < 2.0**63, value, 0).astype("<i8")
            made = [x[e - s : e].tobytes() if u else None for s, e, u in zip(size.tolist(), end.tolist(), usable.tolist(), strict=True)]
            rows = batch.take(pa.array(good[usable]))
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], pa.array([m for m in made if m is not None], pa.binary())], names=[*kept, "x"])

    return source.mapInArrow(run, fields)


def _blocks(column: pa.Array) -> Iterator[np.ndarray]:
    """Matrices of at most about BLOCK_ENTRIES entries from a batch of equally long vectors."""
    if len(column):
        d = len(column[0].as_py()) // 8
        step = max(1, BLOCK_ENTRIES // d)
        for a in range(0, len(column), step):
            yield np.frombuffer(b"".join(column.slice(a, step).to_pylist()), "<i8").reshape(-1, d)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums: a task's sums in two halves of 32 bits, which Spark adds as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = np.zeros(0, np.int64)
        n = 0
        for batch in batches:
            for x in _blocks(batch.column(0)):
                n += len(x)
                if not len(high):
                    high = low = np.zeros(x.shape[1], np.int64)
                high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        at = np.arange(len(high))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(high), pa.array(low), pa.array(np.full(len(at), n))], names=["i", "high", "low", "n"])

    parts = fit.select("x").mapInArrow(run, "i bigint, high bigint, low bigint, n bigint")
    total = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    rows = parts.groupBy("i").agg(*total, F.sum("n").alias("n")).orderBy("i").collect()  # one row a dimension
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def _products(fit: DataFrame, mean: np.ndarray, through: np.ndarray | None = None) -> np.ndarray:
    """Sum of z z' over z = x - mean, or z = through (x - mean), as tasks add it and Spark adds tasks."""
    size = len(mean) if through is None else len(through)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for x in _blocks(batch.column(0)):
                z = (x - mean) @ through.T if through is not None else x - mean
                total += z.T @ z
        for a in range(0, len(total), 256):
            rows = total[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(rows))), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = fit.select("x").mapInArrow(run, "i bigint, row array<double>")
    spread = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    got = spread.toArrow()  # d x d numbers, however many vectors there are
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Householder vectors (unit, one a row) of a symmetric matrix."""
    a = a.copy()
    d = len(a)
    reflectors = np.zeros((max(0, d - 2), d))
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) <= _EPS * _EPS * size or not size:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        reflectors[k, k + 1 :] = v
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2.0 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2.0 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: for each x the number of eigenvalues below it."""
    least = _EPS * _EPS * max(np.abs(off).max(initial=0.0), np.abs(diagonal).max(initial=0.0)) + np.finfo(float).tiny
    q = diagonal[0] - x
    below = (q < 0).astype(int)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[i] - x - off[i - 1] ** 2 / q
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, each bisected until its bracket cannot shrink."""
    d = len(diagonal)
    beside = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    span = float((np.abs(diagonal) + beside).max())
    low, high = np.full(count, -span - 1e-300), np.full(count, span * (1 + 4 * _EPS) + 1e-300)
    wanted = d - np.arange(count)  # so many eigenvalues are at most the i-th largest
    while True:
        middle = (low + high) / 2
        open_ = (middle > low) & (middle < high) & (high - low > _EPS * (np.abs(middle) + _EPS * span))
        if not open_.any():
            return middle
        above = count_below(diagonal, off, middle) >= wanted
        high, low = np.where(open_ & above, middle, high), np.where(open_ & ~above, middle, low)


def _solve(diagonal: np.ndarray, off: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Tridiagonal system by elimination with row interchanges; tiny pivots are lifted to ``least``."""
    d = len(diagonal)
    p, q, r = diagonal.tolist(), [*off.tolist(), 0.0], [0.0] * d
    b = b.tolist()
    sub = off.tolist()
    for i in range(d - 1):
        if abs(sub[i]) > abs(p[i]):
            p[i], sub_i = sub[i], p[i]
            q[i], p[i + 1] = p[i + 1], q[i]
            r[i], q[i + 1] = q[i + 1], 0.0
            b[i], b[i + 1] = b[i + 1], b[i]
        else:
            sub_i = sub[i]
        if abs(p[i]) < least:
            p[i] = least
        m = sub_i / p[i]
        p[i + 1] -= m * q[i]
        q[i + 1] -= m * r[i]
        b[i + 1] -= m * b[i]
    if abs(p[-1]) < least:
        p[-1] = least
    x = [0.0] * (d + 2)
    for i in range(d - 1, -1, -1):
        x[i] = (b[i] - q[i] * x[i + 1] - r[i] * x[i + 2]) / p[i]
    return np.array(x[:d])


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of falling ``values`` by inverse iteration, orthogonal within clusters of close ones."""
    d = len(diagonal)
    norm = float(np.abs(diagonal).max(initial=0.0) + 2 * np.abs(off).max(initial=0.0)) or 1.0
    least, draw = _EPS * norm, np.random.default_rng(12)
    found: list[np.ndarray] = []
    cluster: list[np.ndarray] = []
    shift = np.inf
    for k, value in enumerate(values.tolist()):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = []
        shift = min(value, shift - 10 * least) if cluster else value
        x = draw.standard_normal(d)
        for _ in range(6):
            for _ in range(2):
                for y in cluster:
                    x -= (y @ x) * y
            x /= np.linalg.norm(x)
            x = _solve(diagonal - shift, off, x, least)
            x /= np.abs(x).max()
        for _ in range(2):
            for y in cluster:
                x -= (y @ x) * y
            x /= np.linalg.norm(x)
        found.append(x)
        cluster.append(x)
    return np.array(found).reshape(-1, d)


def leading(covariance: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues above rounding error, falling, and their unit eigenvectors, the largest entry positive."""
    diagonal, off, reflectors = tridiagonal(covariance)
    values = leading_values(diagonal, off, min(count, len(diagonal)))
    values = values[values > len(diagonal) * _EPS * max(np.trace(covariance), np.finfo(float).tiny)]
    made = vectors_of(diagonal, off, values)
    for v in reflectors[::-1]:
        made -= 2.0 * np.outer(made @ v, v)
    top = np.abs(made).argmax(axis=1)
    return values, made * np.sign(made[np.arange(len(made)), top])[:, None]


def fit(grid: DataFrame, components: int = COMPONENTS) -> tuple[Model | None, DataFrame]:
    """The model of the ``x`` vectors of one length, and the rows that have it (all rows, and None, if there are none)."""
    sizes = grid.groupBy(F.length("x").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return None, grid
    grid = grid.where(F.length("x") == most["size"])
    distinct = written(grid.select("x").distinct(), "vectors")
    n, sums = _sums(distinct)
    mean = np.array([s / n for s in sums])  # rounded once
    covariance = _products(distinct, mean) / n
    values, vectors = leading(covariance, components)
    if not len(values):
        return None, grid
    whitened = _products(distinct, mean, vectors / np.sqrt(values)[:, None]) / n
    error = float(np.abs(whitened - np.eye(len(values))).max())
    return Model(n, np.array(sums, object), values, vectors, float(np.trace(covariance)), error), grid


def project(grid: DataFrame, model: Model | None) -> DataFrame:
    """A row for each row of ``grid`` and component: component, n, deviation, whitened, explained, identity_error."""
    kept = [c for c in grid.columns if c != "x"]
    schema = grid.select(*kept).schema
    for name, kind in (("component", "integer"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")):
        schema = schema.add(name, kind)
    if model is None:
        return grid.sparkSession.createDataFrame([], schema)
    count = len(model.values)
    mean = np.array([s / model.n for s in model.sums.tolist()])
    through = (model.vectors / np.sqrt(model.values)[:, None]).T
    explained = model.values / model.trace

    def deviations(x: np.ndarray) -> pa.Array:
        """Exact: in longs where a bound shows that nothing overflows, else in Python's whole numbers."""
        far = np.abs(model.n * x.astype(np.float64) - model.sums.astype(np.float64))
        fits = (np.abs(model.sums.astype(np.float64)) < 2.0**62).all() & (far < 2.0**31).all(axis=1) & ((far**2).sum(axis=1) < 2.0**62)
        out: list[int | None] = [None] * len(x)
        if fits.any():
            small = model.n * x[fits] - model.sums.astype(np.int64)
            for i, v in zip(np.flatnonzero(fits).tolist(), (small**2).sum(axis=1).tolist(), strict=True):
                out[i] = v
        for i in np.flatnonzero(~fits).tolist():
            v = sum((model.n * a - s) ** 2 for a, s in zip(x[i].tolist(), model.sums.tolist(), strict=True))
            out[i] = v if v < 1 << 63 else None
        return pa.array(out, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for x in _blocks(batch.column(len(kept))):
                rows = np.repeat(np.arange(begin, begin + len(x)), count)
                white = (x - mean) @ through
                own = [c.take(pa.array(rows)) for c in batch.columns[: len(kept)]]
                deviation = deviations(x).take(pa.array(rows - begin))
                made = [np.tile(np.arange(1, count + 1, dtype=np.int32), len(x)), np.full(len(rows), model.n)]
                more = [white.ravel(), np.tile(explained, len(x)), np.full(len(rows), model.identity_error)]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, made), deviation, *map(pa.array, more)], names=schema.names)
                begin += len(x)

    return grid.select(*kept, "x").mapInArrow(run, schema)


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vectors`` without ``column``, a row for each usable vector and component, with the columns of ``project``."""
    clash = {"x", "component", "n", "deviation", "whitened", "explained", "identity_error"}
    grid = on_grid(vectors.select(*(F.col(f"`{c}`") for c in vectors.columns if c not in clash or c == column)), column, scale)
    model, usable = fit(grid, components)
    return project(usable, model)
