"""Kernels over dense arrays, as column expressions: classification, thresholds, channels, look-up tables, coordinates.

A tensor is an array column in row-major order, its shape a parameter. Null arrays give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pixels(data: Column, n: int, channels: int) -> Column:
    """Array of the channel vectors of ``n`` pixels, channels last."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.slice(data, p * channels + 1, F.lit(channels)))


def channels_last(data: Column, pixels: int, channels: int) -> Column:
    """A channels-first tensor in channels-last order."""
    order = F.sequence(F.lit(0), F.lit(pixels * channels - 1))
    return F.transform(order, lambda i: F.element_at(data, ((i % channels) * pixels + F.floor(i / channels) + 1).cast("int")))


def argmax_classes(data: Column, pixels: int, channels: int) -> Column:
    """Class of each pixel: the first channel of the greatest value, 0 unless that is above 0."""

    def of(v: Column) -> Column:
        most = F.array_max(F.transform(v, lambda x: F.when(F.isnan(x), F.lit(0.0)).otherwise(x)))
        return F.when(most > 0, F.array_position(v, most) - 1).otherwise(0).cast("int")

    return F.transform(_pixels(data, pixels, channels), of)


def sigmoid_classes(data: Column, pixels: int, channels: int, threshold: float = 0.5) -> Column:
    """1 for each pixel whose first channel reaches ``threshold``."""
    return F.transform(_pixels(data, pixels, channels), lambda v: (v[0] >= threshold).cast("int"))


def max_positions(data: Column, height: int, width: int, channels: int, skip_first: bool = False) -> Column:
    """Per channel the (row / height, column / width) of its first greatest value; ``skip_first`` leaves channel 0 at (0, 0)."""

    def of(c: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda p: F.element_at(data, (p * channels + c + 1).cast("int")))
        at = (F.array_position(own, F.array_max(own)) - 1).cast("int")
        at = F.when(c < int(skip_first), F.lit(0)).otherwise(at)
        return F.struct(c.alias("channel"), (F.floor(at / width) / height).alias("row"), ((at % width) / F.lit(width)).alias("col"))

    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), of)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def binary_class(data: Column, first: str, second: str) -> Column:
    """struct(label, confidence) of two scores, the greater one's; ties go to the second. Null unless there are two."""
    a, b = logistic(data[0]), logistic(data[1])
    return F.when(F.size(data) == 2, F.struct(F.when(a > b, first).otherwise(second).alias("label"), F.greatest(a, b).alias("confidence")))


def binary_class_row(data: Column, columns: list[str]) -> Column:
    """struct of three text ``columns``: 1, 0 and the confidence where the first of two scores is greater, else 0, 1 and the confidence (ties too).

    Null unless there are two scores.
    """
    a, b = logistic(data[0]), logistic(data[1])
    first = (a > b).cast("int")
    values = (first.cast("string"), (1 - first).cast("string"), F.greatest(a, b).cast("string"))
    return F.when(F.size(data) == 2, F.struct(*[v.alias(c) for v, c in zip(values, columns, strict=True)]))


def printed(data: Column, sep: str = ", ", most: int | None = None) -> Column:
    """The values as text; of more than ``most``, the first ones and an ellipsis."""
    text = F.transform(data, lambda x: x.cast("string"))
    if most is None:
        return F.array_join(text, sep)
    return F.concat(F.array_join(F.slice(text, 1, most), sep), F.when(F.size(data) > most, F.lit(sep + "...")).otherwise(""))


# -- pixel formats


def rescale_up(data: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """0..255 to lo..hi."""
    return F.transform(data, lambda x: F.lit(lo) + x * ((hi - lo) / 255.0))


def rescale_down(data: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """lo..hi to 0..255, rounded half up, values outside clamped."""
    return F.transform(data, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x - lo) * (255.0 / (hi - lo)) + 0.5))).cast("int"))


def narrow(data: Column) -> Column:
    """16-bit values to 8 bits: the upper byte."""
    return F.transform(data, lambda x: F.shiftright(x.cast("int"), 8))


def reorder_channels(data: Column, channels: int, order: list[int]) -> Column:
    if sorted(order) != list(range(channels)):
        raise ValueError(f"{order} is no order of {channels} channels")
    take = F.array(*[F.lit(i) for i in order])
    flat = F.sequence(F.lit(0), F.size(data) - 1)
    return F.transform(flat, lambda i: F.element_at(data, (F.floor(i / channels) * channels + F.element_at(take, (i % channels + 1).cast("int")) + 1).cast("int")))


def add_alpha(data: Column, alpha: int = 255) -> Column:
    """Three channels to four."""
    flat = F.sequence(F.lit(0), (F.size(data) / 3 * 4).cast("int") - 1)
    return F.transform(flat, lambda i: F.when(i % 4 == 3, F.lit(alpha)).otherwise(F.element_at(data, (F.floor(i / 4) * 3 + i % 4 + 1).cast("int"))).cast("int"))


def drop_alpha(data: Column) -> Column:
    """Four channels to three."""
    return F.filter(data, lambda x, i: i % 4 != 3)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Column:
    """struct(r, g, b) of full-range BT.601 values, rounded half up and clamped."""
    clamp = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("int")
    r, b = y + 1.402 * (v - 128), y + 1.772 * (u - 128)
    g = y - 0.344136 * (u - 128) - 0.714136 * (v - 128)
    return F.struct(clamp(r).alias("r"), clamp(g).alias("g"), clamp(b).alias("b"))


def looked_up(index: Column, table: list[list[float]]) -> Column:
    """The colour of an index; null outside the table."""
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table])
    return F.when((index >= 0) & (index < len(table)), F.element_at(rows, (index + 1).cast("int")))


# -- coordinates

#: Coordinates of one primitive, and how far the next one starts after it.
PRIMITIVES = {"points": (2, 2), "lines": (4, 4), "line_strip": (4, 2), "triangles": (6, 6), "crosses": (3, 3), "rectangles": (4, 4), "ovals": (4, 4), "text": (3, 3), "points_3d": (3, 3), "lines_3d": (6, 6), "line_strip_3d": (6, 3), "triangles_3d": (9, 9)}


def primitives(data: Column, kind: str) -> Column:
    """Array of the coordinates of each primitive; an incomplete last one is left out."""
    size, step = PRIMITIVES[kind]
    n = F.floor((F.size(data) - size) / step).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(data, i * step + 1, F.lit(size)))).otherwise(F.filter(F.array(data), lambda x: F.lit(False)))


def depth_points(data: Column, width: int) -> Column:
    """(x, y, depth) of each value of a depth map."""
    return F.transform(data, lambda z, i: F.struct((i % width).alias("x"), F.floor(i / width).cast("int").alias("y"), z.alias("z")))


def primitive_kind(components: Column, has_table: Column, is_float: Column, is_image: Column) -> Column:
    """What a tensor is shown as, by its channels and type; null if it is none of them."""
    return F.when((components == 1) & has_table, "color_lut").when((components == 2) & is_float, "crosses").when(is_image, "color")
