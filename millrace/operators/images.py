"""Image kernels: histogram equalisation, boxes and masks of detections, demosaicing, resizing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import matched


def equalized_bins(df: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """(keys, bin, n, level): each key's values scaled to bins between their least and greatest, and the level that equalises the histogram.

    A constant key has level 0. Values are counted before any ordering, so a window sees at most ``bins`` rows a key.
    """
    span = df.groupBy(*keys).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    rows = matched(df, span, keys) if keys else df.crossJoin(F.broadcast(span))  # one row
    scaled = F.when(F.col("hi_") > F.col("lo_"), F.floor((bins - 1) * (F.col(value) - F.col("lo_")) / (F.col("hi_") - F.col("lo_")))).otherwise(0)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, scaled.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    cdf = counts.withColumn("cdf_", F.sum("n").over(up)).withColumn("low_", F.min("cdf_").over(every)).withColumn("all_", F.sum("n").over(every))
    level = F.when(F.col("all_") > F.col("low_"), F.floor((bins - 1) * (F.col("cdf_") - F.col("low_")) / (F.col("all_") - F.col("low_")))).otherwise(0)
    return cdf.select(*keys, "bin", "n", level.cast("int").alias("level"))


def detections(boxes: Column, scores: Column, labels: Column) -> Column:
    """Array of struct(idx, x1, y1, x2, y2, score, label) of three parallel arrays."""
    return F.transform(scores, lambda s, i: F.struct(i.alias("idx"), *[F.element_at(boxes, (i * 4 + k + 1).cast("int")).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], s.alias("score"), F.element_at(labels, (i + 1).cast("int")).alias("label")))


def first_boxes(df: DataFrame, key: str, found: Column, names: list[str], objects: dict[str, int], threshold: float = 0.75, width: float = 1920.0, height: float = 1080.0) -> DataFrame:
    """(key, label, slot, x1, y1, x2, y2, text_x, text_y, text_size, used): a grid of ``objects[label]`` slots a label.

    Detections above ``threshold`` fill their label's slots in input order (not by score); a label number that is not in
    ``names`` or ``objects`` is ``object``. Unused slots are zero boxes with their text at (1.1, 1.1). Coordinates are shares of the image.
    """
    known = {n for n in names if n in objects}
    # labels are told once, as a number among the objects; what is no object has -1
    order = [k for k, n in objects.items() if n > 0]
    number = [order.index(n if n in known else "object") if (n if n in known else "object") in order else -1 for n in names]
    other = order.index("object") if "object" in order else -1
    of = F.array(*[F.lit(i) for i in number]) if number else F.array(F.lit(other))

    def kind(d: Column) -> Column:
        return F.when((d["label"] >= 0) & (d["label"] < len(number)), F.get(of, d["label"].cast("int"))).otherwise(other)

    rows = df.select(F.col(key).alias("key_"), F.filter(found, lambda d: d["score"] > threshold).alias("kept_"))
    rows = rows.withColumn("kinds_", F.transform("kept_", kind))
    slots = [(i, k, s) for i, k in enumerate(order) for s in range(objects[k])]
    # the place of the detection that fills each slot: the nth one of its kind
    places = rows.withColumn("places_", F.array(*[F.filter(F.transform("kinds_", lambda k, j: F.when(k == i, j)), lambda j: j.isNotNull()) for i in range(len(order))]))  # noqa: B023
    grid = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(s).alias("slot"), F.lit(i).alias("i")) for i, k, s in slots])
    each = places.select("key_", "kept_", "places_", F.explode(grid).alias("s_"))
    each = each.select("key_", "s_.label", "s_.slot", F.get("kept_", F.get(F.get("places_", F.col("s_.i")), F.col("s_.slot"))).alias("d_"))
    used = F.col("d_").isNotNull()
    at = {c: F.coalesce(F.col("d_")[c] / size, F.lit(0.0)) for c, size in (("x1", width), ("y1", height), ("x2", width), ("y2", height))}
    text = (F.when(used, at["x2"]).otherwise(1.1), F.when(used, at["y1"]).otherwise(1.1))
    return each.select(F.col("key_").alias(key), "label", "slot", *[v.alias(c) for c, v in at.items()], text[0].alias("text_x"), text[1].alias("text_y"), F.lit(0.05).alias("text_size"), used.alias("used"))


def painted(found: DataFrame, keys: list[str], pixel: str, idx: str, value: str, color: str, threshold: float = 0.5) -> DataFrame:
    """(keys, pixel, color): the colour of the last detection whose mask covers a pixel above ``threshold``; other pixels have no row."""
    return found.where(F.col(value) > threshold).groupBy(*keys, pixel).agg(F.max_by(color, idx).alias(color))


#: Colour (0 red, 1 green, 2 blue) of the 2 x 2 cell, by row, for each grid position.
GRIDS = {0: ((2, 1), (1, 0)), 1: ((0, 1), (1, 2)), 2: ((1, 2), (0, 1)), 3: ((1, 0), (2, 1))}


def demosaic(data: Column, height: int, width: int, grid: int = 2, alpha: int | None = None) -> Column:
    """RGB (RGBA with ``alpha``) of a Bayer mosaic: each colour is the mean, rounded down, of its samples in the pixel's 3 x 3 neighbourhood; a sample of the pixel's own colour stands."""
    cell = np.array(GRIDS[grid])

    @F.pandas_udf("array<int>")
    def run(frames: pd.Series) -> pd.Series:
        if not len(frames):
            return pd.Series([], dtype=object)
        raw = np.stack(frames.to_numpy()).reshape(-1, height, width).astype(np.int64)
        rows, cols = np.indices((height, width))
        color = cell[rows % 2, cols % 2]
        out = np.zeros((*raw.shape, 3), np.int64)
        for c in range(3):
            own = color == c
            total, n = np.zeros_like(raw), np.zeros((height, width), np.int64)
            padded, mask = np.pad(raw * own, ((0, 0), (1, 1), (1, 1))), np.pad(own.astype(np.int64), 1)
            for dy in range(3):
                for dx in range(3):
                    total += padded[:, dy : dy + height, dx : dx + width]
                    n += mask[dy : dy + height, dx : dx + width]
            out[..., c] = np.where(own, raw, total // np.maximum(n, 1))
        if alpha is not None:
            out = np.concatenate([out, np.full((*raw.shape, 1), alpha)], axis=-1)
        return pd.Series(list(out.reshape(len(raw), -1).astype(np.int32)))

    return run(data)


def resize_nearest(data: Column, height: int, width: int, channels: int, to_height: int, to_width: int) -> Column:
    """Nearest neighbour: output (y, x) is input (floor(y * height / to_height), floor(x * width / to_width))."""

    def at(i: Column) -> Column:
        p, c = F.floor(i / channels), i % channels
        y, x = F.floor(F.floor(p / to_width) * height / to_height), F.floor(p % to_width * width / to_width)
        return F.element_at(data, ((y * width + x) * channels + c + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(to_height * to_width * channels - 1)), at)


def cubic_weights(n: int, to: int) -> np.ndarray:
    """(to, n): how much each of ``n`` samples counts in each of ``to``: cubic convolution with a slope of -1/2, sample centres in line, the edge repeated."""
    out = np.zeros((to, n))
    for i in range(to):
        at = (i + 0.5) * n / to - 0.5
        first = int(np.floor(at)) - 1
        for k in range(first, first + 4):
            d = abs(at - k)
            w = 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0
            out[i, min(max(k, 0), n - 1)] += w
    return out


def resize_cubic(data: Column, height: int, width: int, channels: int, to_height: int, to_width: int) -> Column:
    """Cubic convolution over rows, then columns; 8-bit values, rounded half up and clamped. Null images give null."""
    down, across = cubic_weights(height, to_height), cubic_weights(width, to_width)

    @F.pandas_udf("array<int>")
    def run(frames: pd.Series) -> pd.Series:
        return _each(frames, lambda x: np.clip(np.floor(np.einsum("ij,bjkc,lk->bilc", down, x.reshape(-1, height, width, channels), across, optimize=True) + 0.5), 0, 255))

    return run(data)


def _each(frames: pd.Series, kernel) -> pd.Series:
    """``kernel`` over the images that are not null, (images, values) at a time."""
    out = pd.Series([None] * len(frames), index=frames.index, dtype=object)
    have = frames.notna()
    if have.any():
        made = kernel(np.stack(frames[have].to_numpy()).astype(float))
        out[have] = pd.Series(list(made.reshape(len(made), -1).astype(np.int32)), index=frames.index[have])
    return out


#: The weights of red and blue in the luma of BT.601 and BT.709.
LUMA = {"601": (0.299, 0.114), "709": (0.2126, 0.0722)}
#: How the chroma samples lie after the luma plane (yuyv: packed Y U Y V). Chroma is halved both ways, in yuyv across only.
LAYOUTS = ("yuv420", "nv12", "yuyv")


def _ranges(full: bool) -> tuple[float, float, float]:
    """(luma of black, luma's range, chroma's range) of 8 bits."""
    return (0.0, 255.0, 255.0) if full else (16.0, 219.0, 224.0)


def _checked(height: int, width: int, layout: str) -> None:
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    if width % 2 or (layout != "yuyv" and height % 2):
        raise ValueError(f"{height} x {width} has no whole chroma samples")


def planes_to_rgb(data: Column, height: int, width: int, layout: str = "yuv420", luma: str = "601", full: bool = True) -> Column:
    """RGB, channels last, of subsampled YUV; a chroma sample serves all its pixels; rounded half up and clamped."""
    _checked(height, width, layout)
    (kr, kb), (black, y_range, c_range) = LUMA[luma], _ranges(full)
    n = height * width

    def kernel(x: np.ndarray) -> np.ndarray:
        if layout == "yuyv":
            x = x.reshape(-1, height, width // 2, 4)
            y, u, v = x[..., ::2].reshape(-1, height, width), x[..., 1], x[..., 3]
            u, v = (c.repeat(2, axis=2) for c in (u, v))
        else:
            y, c = x[:, :n].reshape(-1, height, width), x[:, n:]
            u, v = (c[:, ::2], c[:, 1::2]) if layout == "nv12" else (c[:, : n // 4], c[:, n // 4 :])
            u, v = (c.reshape(-1, height // 2, width // 2).repeat(2, axis=1).repeat(2, axis=2) for c in (u, v))
        y, u, v = (y - black) * (255 / y_range), (u - 128) * (255 / c_range), (v - 128) * (255 / c_range)
        r, b = y + 2 * (1 - kr) * v, y + 2 * (1 - kb) * u
        g = y - (2 * kb * (1 - kb) / (1 - kr - kb)) * u - (2 * kr * (1 - kr) / (1 - kr - kb)) * v
        return np.clip(np.floor(np.stack([r, g, b], axis=-1) + 0.5), 0, 255)

    @F.pandas_udf("array<int>")
    def run(frames: pd.Series) -> pd.Series:
        return _each(frames, kernel)

    return run(data)


def rgb_to_planes(data: Column, height: int, width: int, layout: str = "yuv420", luma: str = "601", full: bool = True) -> Column:
    """Subsampled YUV of RGB, channels last: a chroma sample is the mean of its pixels', added up row by row; rounded half up and clamped."""
    _checked(height, width, layout)
    (kr, kb), (black, y_range, c_range) = LUMA[luma], _ranges(full)
    whole = lambda x: np.clip(np.floor(x + 0.5), 0, 255)

    def kernel(x: np.ndarray) -> np.ndarray:
        r, g, b = np.moveaxis(x.reshape(-1, height, width, 3), -1, 0)
        y = kr * r + (1 - kr - kb) * g + kb * b
        u, v = (b - y) / (2 * (1 - kb)), (r - y) / (2 * (1 - kr))
        down = 1 if layout == "yuyv" else 2
        cells = [[c.reshape(-1, height // down, down, width // 2, 2)[:, :, i, :, j] for i in range(down) for j in range(2)] for c in (u, v)]
        u, v = (sum(c[1:], c[0]) / len(c) * (c_range / 255) + 128 for c in cells)  # added up row by row: at a half, the order decides
        y, u, v = whole(y * (y_range / 255) + black), whole(u), whole(v)
        if layout == "yuyv":
            y = y.reshape(-1, height, width // 2, 2)
            return np.stack([y[..., 0], u, y[..., 1], v], axis=-1)
        flat = [c.reshape(len(c), -1) for c in (y, u, v)]
        if layout == "nv12":
            return np.concatenate([flat[0], np.stack(flat[1:], axis=-1).reshape(len(y), -1)], axis=1)
        return np.concatenate(flat, axis=1)

    @F.pandas_udf("array<int>")
    def run(frames: pd.Series) -> pd.Series:
        return _each(frames, kernel)

    return run(data)
