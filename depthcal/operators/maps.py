"""Depth maps and masks as row-major array columns: reductions, calibration, run-length masks, resizing, colours.

Everything that looks at one map is an expression on its row, so nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric
from ..functions.scalar import INF
from .calibrators import predict


def finite(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF))


def in_mask(depth: Column, mask: Column) -> Column:
    """The finite values under the mask."""
    return finite(F.filter(F.zip_with(depth, mask, lambda d, m: F.when(m, d)), lambda x: x.isNotNull()))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")),
                       lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def median_of(values: Column) -> Column:
    """Exact median of an array, the mean of the middle two where their number is even."""
    def middle(s):
        n = F.size(s)
        low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)

    return F.element_at(F.transform(F.array(F.sort_array(values)), middle), 1)


def mask_geometry(mask: Column, width: Column) -> Column:
    """struct(area, min_x, max_x, min_y, max_y, center_x, center_y); null for an empty mask."""
    at = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())

    def shape(p):
        xs, ys = F.transform(p, lambda i: i % width), F.transform(p, lambda i: F.floor(i / width).cast("int"))
        box = [F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)]
        half = lambda lo, hi: F.floor((lo + hi) / 2).cast("int")
        return F.when(F.size(p) > 0, F.struct(F.size(p).alias("area"), *(c.alias(n) for c, n in zip(box, ("min_x", "max_x", "min_y", "max_y"), strict=True)),
                                              half(box[0], box[1]).alias("center_x"), half(box[2], box[3]).alias("center_y")))

    return F.element_at(F.transform(F.array(at), shape), 1)


def center_row(center_y: Column, height: Column) -> Column:
    return (center_y + 0.5) / height


def value_at(depth: Column, x: Column, y: Column, width: Column) -> Column:
    """Depth at a pixel; null where it isn't finite."""
    d = F.get(depth, (y * width + x).cast("int"))
    return F.when(~F.isnan(d) & (F.abs(d) < INF), d)


def union_mask(masks: Column) -> Column:
    """Pixelwise or of an array of masks."""
    return F.aggregate(F.slice(masks, F.lit(2), F.greatest(F.size(masks) - 1, F.lit(0))), F.get(masks, F.lit(0)), lambda a, m: F.zip_with(a, m, lambda x, y: x | y))


def number_instances(instances: Column) -> Column:
    """Instances, structs with ``center_x``, without empty ones and in the order of center_x; instance_idx is the place.

    Equal centers keep their order of detection.
    """
    kept = F.filter(instances, lambda m: m["area"] > 0)
    keyed = F.sort_array(F.transform(kept, lambda m, i: F.struct(m["center_x"].alias("x"), i.alias("i"))))
    return F.element_at(F.transform(F.array(F.struct(kept.alias("m"), keyed.alias("k"))), lambda s: F.transform(s["k"], lambda k, i: F.struct(i.alias("instance_idx"), F.get(s["m"], k["i"]).alias("instance")))), 1)


def apply_map(method: str, depth: Column, params: dict[str, Column], height: Column | None = None, width: Column | None = None) -> Column:
    """Calibrated map: finite positive pixels change, others pass; a result that isn't finite and positive is NaN."""
    def pixel(d, i):
        v = (F.floor(i / width) + 0.5) / height if method == "poly2d" else None
        value = predict(method, d, params, v)
        good = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < INF)
        return F.when(~F.isnan(d) & (d > 0) & (d < INF), F.when(good, value).otherwise(F.lit(float("nan")))).otherwise(d).cast("float")

    return F.transform(depth, pixel)


def apply_fits(frames: DataFrame, fits: DataFrame, method: str) -> DataFrame:
    """Each frame (group_key, depth) with ``calibrated`` by its group's fit, once per frame."""
    joined = frames.join(fits.drop("n_points"), "group_key")
    params = {c: F.col(c) for c in fits.columns}
    return joined.withColumn("calibrated", apply_map(method, F.col("depth"), params, F.col("h"), F.col("w")))


def mask_runs(mask: Column, height: int, width: int) -> Column:
    """Lengths of runs down the columns, beginning with a run of background, which may be of no length."""
    order = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.get(mask, y * width + x))))
    step = F.struct(F.lit(False).alias("last"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("runs"))
    return F.aggregate(order, step, lambda a, m: F.when(a["last"] == m, F.struct(a["last"].alias("last"), (a["n"] + 1).alias("n"), a["runs"].alias("runs"))).otherwise(
        F.struct(m.alias("last"), F.lit(1).alias("n"), F.array_append(a["runs"], a["n"]).alias("runs"))), lambda a: F.array_append(a["runs"], a["n"]))


def pack_runs(runs: list[int]) -> str:
    """Runs as text: from the third on as differences to the run before the last, five bits a character from 48."""
    out = []
    for k, run in enumerate(runs):
        x = int(run) - (int(runs[k - 2]) if k > 2 else 0)
        more = True
        while more:
            bits, x = x & 31, x >> 5
            more = x != (-1 if bits & 16 else 0)
            out.append(chr(48 + bits + 32 * more))
    return "".join(out)


def unpack_runs(text: str) -> list[int]:
    runs: list[int] = []
    value = shift = 0
    for c in text:
        bits = ord(c) - 48
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            if bits & 16:
                value -= 1 << shift
            runs.append(value + (runs[-2] if len(runs) > 2 else 0))
            value = shift = 0
    return runs


def runs_of(mask: np.ndarray) -> list[int]:
    flat = np.asarray(mask, bool).ravel(order="F")
    edges = np.flatnonzero(np.diff(flat)) + 1
    runs = np.diff(np.concatenate([[0], edges, [len(flat)]])).tolist() if len(flat) else []
    return [0, *runs] if len(flat) and flat[0] else runs


def encode_mask(mask: np.ndarray) -> dict:
    return {"size": list(mask.shape), "counts": pack_runs(runs_of(mask))}


def decode_mask(rle: dict) -> np.ndarray:
    runs = unpack_runs(rle["counts"])
    return np.repeat(np.arange(len(runs)) % 2 == 1, runs).reshape(rle["size"], order="F")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def decode_masks(size: pd.Series, counts: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else decode_mask({"size": list(s), "counts": c}).ravel() for s, c in zip(size, counts, strict=True)])


@F.pandas_udf(T.StringType())
def encode_masks(size: pd.Series, mask: pd.Series) -> pd.Series:
    return pd.Series([None if m is None else pack_runs(runs_of(np.asarray(m, bool).reshape(tuple(s)))) for s, m in zip(size, mask, strict=True)])


def resize_nearest(values: Column, h: Column | int, w: Column | int, to_h: Column | int, to_w: Column | int) -> Column:
    """Nearest neighbour, the pixel under the corner of each target pixel."""
    h, w, to_h, to_w = (F.lit(n) if isinstance(n, int) else n for n in (h, w, to_h, to_w))
    places = lambda n, to: F.when(to > 0, F.transform(F.sequence(F.lit(0), to - 1), lambda k: F.floor(k * n / to).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(places(h, to_h), lambda y: F.transform(places(w, to_w), lambda x: F.get(values, y * w + x))))


def resize_nearest_array(mask: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    rows, columns = (np.arange(to) * n // to for n, to in zip(mask.shape, shape, strict=True))
    return mask if mask.shape == tuple(shape) else mask[np.ix_(rows, columns)]


def _cubic(n: int, to: int) -> np.ndarray:
    """Weights of cubic convolution (a = -0.75) with repeated borders, one row for each target position."""
    out = np.zeros((to, n))
    for k in range(to):
        x = (k + 0.5) * n / to - 0.5
        base = int(np.floor(x))
        for j in range(base - 1, base + 3):
            t = abs(x - j)
            weight = 1.25 * t**3 - 2.25 * t**2 + 1 if t <= 1 else -0.75 * (t**3 - 5 * t**2 + 8 * t - 4)
            out[k, min(max(j, 0), n - 1)] += weight
    return out


def resize_cubic(depth: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    if depth.shape == tuple(shape):
        return depth
    return (_cubic(depth.shape[0], shape[0]) @ depth.astype(float) @ _cubic(depth.shape[1], shape[1]).T).astype(np.float32)


def colour_index(depth: Column) -> Column:
    """Palette places 0 to 255 by the range of the finite values; NaN and -inf are 0, +inf 255; no finite value: all 0."""
    def scaled(s):
        lo, hi = F.array_min(s), F.array_max(s)

        def pixel(d):
            share = F.when(F.isnan(d), 0.0).when(d == INF, 1.0).when(d == -INF, 0.0).otherwise(F.when(hi > lo, (d - lo) / (hi - lo)).otherwise(0.0))
            return F.floor(F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))) * 255).cast("int")

        return F.when(F.size(s) == 0, F.transform(depth, lambda d: F.lit(0))).otherwise(F.transform(depth, pixel))

    return F.element_at(F.transform(F.array(finite(depth)), scaled), 1)


def calibrate_maps(frames: DataFrame, method: str, params: dict) -> DataFrame:
    """One fit applied to (h, w, depth) maps with numpy, batch by batch."""
    @F.pandas_udf("array<float>")
    def run(h: pd.Series, w: pd.Series, depth: pd.Series) -> pd.Series:
        return pd.Series([numeric.apply_to_map(method, params, np.asarray(d, float).reshape(a, b)).ravel() for a, b, d in zip(h, w, depth, strict=True)])

    return frames.withColumn("calibrated", run("h", "w", "depth"))
