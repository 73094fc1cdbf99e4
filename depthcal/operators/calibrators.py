"""Per-group fits. Closed forms are aggregates; pairwise ones are joins within the group; rank-deficient polynomials
are grouped pandas functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.grouped import map_groups
from ..functions.numeric import METHODS, MIN_POINTS
from ..functions.scalar import INF
from .points import clean

__all__ = ["METHODS", "MIN_POINTS"]


def line_columns(x: Column, y: Column, a: str = "a", b: str = "b") -> list[Column]:
    """Aggregates for a line: one point gives a ratio, equal x the least-norm solution, else least squares."""
    one, flat = F.count(x) == 1, F.min(x) == F.max(x)
    slope = F.when(one, F.min(y) / F.min(x)).when(flat, F.avg(y) / (2 * F.min(x))).otherwise(F.regr_slope(y, x))
    shift = F.when(one, F.lit(0.0)).when(flat, F.avg(y) / 2).otherwise(F.regr_intercept(y, x))
    return [slope.alias(a), shift.alias(b)]


def _groups(points: DataFrame):
    return clean(points).groupBy("group_key")


def fit_scale(points: DataFrame, robust: bool = False) -> DataFrame:
    x, y = F.col("pred"), F.col("gt_m")
    s = F.median(y / x) if robust else F.sum(x * y) / F.sum(x * x)
    return _groups(points).agg(F.count("*").alias("n_points"), s.alias("s"))


def fit_linear(points: DataFrame) -> DataFrame:
    return _groups(points).agg(F.count("*").alias("n_points"), *line_columns(F.col("pred"), F.col("gt_m")))


def fit_disparity(points: DataFrame) -> DataFrame:
    """A line of inverse distance over inverse prediction."""
    return _groups(points).agg(F.count("*").alias("n_points"), *line_columns(1 / F.col("pred"), 1 / F.col("gt_m")))


def fit_theil_sen(points: DataFrame) -> DataFrame:
    """Median of the slopes of all pairs with different predictions (0 without one), then the median offset."""
    p = clean(points).select("group_key", "pred", "gt_m")
    left, right = p.toDF("group_key", "x0", "y0"), p.toDF("group_key", "x1", "y1")
    pairs = left.join(right, "group_key").where("x0 < x1")
    slopes = pairs.groupBy("group_key").agg(F.median((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).alias("slope"))
    with_slope = p.join(slopes, "group_key", "left").withColumn("a", F.coalesce("slope", F.lit(0.0)))
    fit = with_slope.groupBy("group_key").agg(F.count("*").alias("n_points"), F.first("a").alias("a"), F.median(F.col("gt_m") - F.col("a") * F.col("pred")).alias("m"),
                                              (F.min("gt_m") / F.min("pred")).alias("ratio"))
    one = F.col("n_points") == 1
    return fit.select("group_key", "n_points", F.when(one, F.col("ratio")).otherwise(F.col("a")).alias("a"), F.when(one, F.lit(0.0)).otherwise(F.col("m")).alias("b"))


def fit_piecewise(points: DataFrame) -> DataFrame:
    """Two joined segments: each inner distinct prediction is tried as the joint; the least squared error wins, and of
    equals the smallest joint. Below four points or without an inner value: one line with an infinite joint.

    One shuffle by group: the moments of the points up to each joint, and of those behind it, are running ones about their
    own means, so that close predictions lose no digits; the errors follow from them in closed form.
    """
    g = W.partitionBy("group_key")
    x, y = F.col("pred"), F.col("gt_m")
    p = clean(points).select("group_key", "pred", "gt_m")
    p = p.select("*", F.dense_rank().over(g.orderBy("pred")).alias("d"))
    up_to, behind = g.orderBy("pred").rangeBetween(W.unboundedPreceding, 0), g.orderBy(F.desc("d")).rangeBetween(W.unboundedPreceding, -1)
    terms = {"n": F.count(x), "x": F.avg(x), "y": F.avg(y), "xx": F.regr_sxx(y, x), "xy": F.regr_sxy(y, x), "yy": F.regr_syy(y, x)}
    p = p.select("*", *(c.over(up_to).alias(f"l_{k}") for k, c in terms.items()), *(c.over(behind).alias(f"r_{k}") for k, c in terms.items()))
    lo, hi = ({k: F.col(f"{side}_{k}") for k in terms} for side in "lr")
    p = p.select("*", F.try_divide(lo["xy"], lo["xx"]).alias("a1"))
    a1, k = F.col("a1"), F.col("pred")
    dx, dy = hi["x"] - k, hi["y"] - (a1 * (k - lo["x"]) + lo["y"])
    oo, oz, zz = hi["xx"] + hi["n"] * dx * dx, hi["xy"] + hi["n"] * dx * dy, hi["yy"] + hi["n"] * dy * dy
    error = lo["yy"] - a1 * lo["xy"] + zz - F.try_divide(oz * oz, oo)
    inner = (F.col("d") > 1) & (hi["n"] > 0)
    joint = F.min_by(F.when(inner, F.col("pred")), F.when(inner, F.struct(error.alias("e"), F.col("pred")))).over(g)
    p = p.select("group_key", "pred", "gt_m", F.when(F.count("*").over(g) >= 4, joint).alias("k"))
    # The winning segments are fitted directly.
    low = F.when(x <= F.col("k"), y)
    p = p.select("*", F.regr_slope(low, x).over(g).alias("a1"), F.regr_intercept(low, x).over(g).alias("b1"))
    over = F.when(x > F.col("k"), x - F.col("k"))
    rise = F.try_divide(F.sum(over * (y - (F.col("a1") * F.col("k") + F.col("b1")))), F.sum(over * over))
    out = p.groupBy("group_key").agg(F.count("*").alias("n_points"), *line_columns(x, y, "la", "lb"), F.min("a1").alias("a1"), F.min("b1").alias("b1"), rise.alias("a2"), F.min("k").alias("k"))
    lone = F.col("k").isNull()
    return out.select("group_key", "n_points", *(F.when(lone, F.col(f"l{c[0]}")).otherwise(F.col(c)).alias(c) for c in ("a1", "b1", "a2")), F.coalesce("k", F.lit(INF)).alias("k"))


def _fit_in_pandas(points: DataFrame, method: str, degree: int, robust: bool) -> DataFrame:
    def run(key, own):
        v = own["v"] if method == "poly2d" else None
        p = numeric.fit(method, own["pred"], own["gt_m"], v, degree, robust)
        return {"group_key": [key], "n_points": [int(numeric.usable(own["pred"], own["gt_m"], v).sum())], "params": [json.dumps(p)], "coeffs": [p.get("coeffs")]}

    rows = clean(points, rows=method == "poly2d").select("group_key", "pred", "gt_m", "v")
    return map_groups(rows, run, "group_key string, n_points long, params string, coeffs array<double>")


def fit_poly(points: DataFrame, degree: int = 2) -> DataFrame:
    return _fit_in_pandas(points, "poly", degree, False)


def fit_poly2d(points: DataFrame) -> DataFrame:
    return _fit_in_pandas(points, "poly2d", 2, False)


#: Methods by name: a function of the points to a fit. Further ones may be registered.
REGISTRY = {
    ("scale", False): fit_scale, ("scale", True): lambda p: fit_scale(p, robust=True), ("linear", False): fit_linear,
    ("linear", True): fit_theil_sen, ("disparity", False): fit_disparity, ("piecewise", False): fit_piecewise,
    ("poly", False): fit_poly, ("poly2d", False): fit_poly2d,
}


def register(method: str, function, robust: bool = False) -> None:
    REGISTRY[method, robust] = function


def fit(points: DataFrame, method: str, robust: bool = False, **options) -> DataFrame:
    """Fit a registered method for each group; groups without a usable point have no row."""
    if (method, False) not in REGISTRY:
        raise ValueError(f"unknown method {method}")
    return REGISTRY.get((method, robust), REGISTRY[method, False])(points, **options)


def predict(method: str, d: Column, p: dict[str, Column], v: Column | None = None) -> Column:
    """The calibrated value as an expression of parameter columns."""
    if method == "scale":
        return p["s"] * d
    if method == "linear":
        return p["a"] * d + p["b"]
    if method == "disparity":
        under = p["a"] / d + p["b"]
        return F.when(under == 0, F.lit(INF)).otherwise(F.try_divide(F.lit(1.0), under))
    if method == "poly":
        return F.aggregate(p["coeffs"], F.lit(0.0), lambda acc, c: acc * d + c)
    if method == "poly2d":
        terms = F.array(F.lit(1.0), d, v, v * d, d * d, v * v)
        return F.aggregate(F.zip_with(p["coeffs"], F.slice(terms, F.lit(1), F.size(p["coeffs"])), lambda c, t: c * t), F.lit(0.0), lambda a, t: a + t)
    if method == "piecewise":
        low = p["a1"] * d + p["b1"]
        return F.when((p["k"] == INF) | (d <= p["k"]), low).otherwise(p["a1"] * p["k"] + p["b1"] + p["a2"] * (d - p["k"]))
    raise ValueError(f"unknown method {method}")
