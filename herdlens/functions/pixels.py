"""Pixel-array expressions: the built-in, JVM-side definition of each frame operator.

A frame is a row-major ``array<float>`` with its height and width beside it. These forms suit small
frames and serve as the checked definition; ``operators.enhance`` has the Arrow path for full-size ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_to_max(pixels: Column, max_value: float) -> Column:
    """Values at or above ``max_value`` become ``max_value``; NaN stays NaN."""
    limit = F.lit(float(max_value)).cast("float")
    return F.transform(pixels, lambda x: F.when(~F.isnan(x) & (x >= limit), limit).otherwise(x))


def scale_by_max(pixels: Column, max_value: float) -> Column:
    """Divide by a fixed maximum, in single precision."""
    return F.transform(pixels, lambda x: (x / F.lit(float(max_value))).cast("float"))


def replicate_channel(pixels: Column, channels: int) -> Column:
    """One channel to ``channels`` equal ones, interleaved per pixel."""
    return F.flatten(F.transform(pixels, lambda x: F.array_repeat(x, channels)))


def _fitted(height: Column, width: Column, target_h: int, target_w: int) -> tuple[Column, ...]:
    """Size and offset of the resized picture inside the target, in single-precision steps."""

    def single(x: Column) -> Column:
        return x.cast("float").cast("double")

    ratio = F.greatest(single(width / F.lit(float(target_w))), single(height / F.lit(float(target_h))))
    exact_h, exact_w = single(height / ratio), single(width / ratio)

    def margin(target: int, exact: Column) -> Column:
        gap = single(single(F.lit(float(target)) - exact) / F.lit(2.0))
        return F.greatest(F.lit(0), F.floor(gap).cast("int"))

    return (
        F.floor(exact_h).cast("int"),
        F.floor(exact_w).cast("int"),
        margin(target_h, exact_h),
        margin(target_w, exact_w),
    )


def _axis(size: Column, fitted: Column) -> Column:
    """For each output position along one side: the pixels on both sides, and the blend between them."""
    positions = F.when(fitted > 0, F.sequence(F.lit(0), fitted - 1)).otherwise(F.array().cast("array<int>"))

    def around(i: Column) -> Column:
        at = (i + 0.5) * size / fitted - 0.5
        return F.struct(
            F.greatest(F.lit(0), F.floor(at).cast("int")).alias("low"),
            F.least(size - 1, F.ceil(at).cast("int")).alias("high"),
            (at - F.floor(at)).alias("part"),
        )

    return F.transform(positions, around)


def resize_with_padding(pixels: Column, height: Column, width: Column, shape: tuple[int, int]) -> Column:
    """Bilinear resize keeping the aspect ratio, centred on a zero background of ``shape``."""
    target_h, target_w = shape
    fit_h, fit_w, top, left = _fitted(height.cast("double"), width.cast("double"), target_h, target_w)
    axes = F.struct(
        _axis(height, fit_h).alias("rows"), _axis(width, fit_w).alias("cols"), top.alias("top"), left.alias("left")
    )

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0).cast("float"), n)

    def at(row: Column, col: Column) -> Column:
        return F.get(pixels, row * width + col).cast("double")

    def draw(a: Column) -> Column:
        def line(y: Column) -> Column:
            def blend(x: Column) -> Column:
                def across(row: Column) -> Column:
                    first = at(row, x["low"])
                    return first + (at(row, x["high"]) - first) * x["part"]

                upper = across(y["low"])
                return (upper + (across(y["high"]) - upper) * y["part"]).cast("float")

            right = F.lit(target_w) - a["left"] - F.size(a["cols"])
            return F.concat(zeros(a["left"]), F.transform(a["cols"], blend), zeros(right))

        blank = zeros(F.lit(target_w))
        below = F.lit(target_h) - a["top"] - F.size(a["rows"])
        return F.flatten(
            F.concat(F.array_repeat(blank, a["top"]), F.transform(a["rows"], line), F.array_repeat(blank, below))
        )

    # The lambda's argument is worked out once per frame; written out, it would be once per pixel.
    return F.get(F.transform(F.array(axes), draw), F.lit(0))
