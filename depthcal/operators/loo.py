"""Leave-one-out scores: closed forms over windows for lines and scales, grouped pandas for the rest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.grouped import map_sorted
from ..functions.numeric import MIN_POINTS
from ..functions.scalar import INF
from .points import clean

BUCKETS = (("close", 1.0, 4.0), ("medium", 4.0, 8.0), ("long", 8.0, INF))


def loo_linear(points: DataFrame) -> DataFrame:
    """One row for each usable point: group_key, gt_m, err_uncal, err_cal (null where the group is too small)."""
    return _line(points, F.col("pred"), F.col("gt_m"), lambda value: value, "linear")


def loo_disparity(points: DataFrame) -> DataFrame:
    inverse = lambda value: F.when(value == 0, F.lit(INF)).otherwise(F.try_divide(F.lit(1.0), value))
    return _line(points, 1 / F.col("pred"), 1 / F.col("gt_m"), inverse, "disparity")


def _line(points: DataFrame, x: Column, y: Column, back, method: str) -> DataFrame:
    """Lines refitted without each point, from sums over the points before and behind it in the order of x.

    Sums are taken about the group's median, near which the others lie even where the point left out is far off, and
    nothing is subtracted from a total, so no digits are lost. One shuffle by group, no self-join.
    """
    g = W.partitionBy("group_key")
    p = clean(points).select("group_key", "pred", "gt_m", x.alias("x"), y.alias("y"))
    p = p.select("*", F.count("*").over(g).alias("n"), F.median("x").over(g).alias("cx"), F.avg("y").over(g).alias("cy"), F.min("x").over(g).alias("lo"),
                 F.max("x").over(g).alias("hi"), F.row_number().over(g.orderBy("x", "y")).alias("i"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    sides = [g.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.col("i"), F.col("i").desc())]
    zero = F.lit(0.0)
    others = {k: sum((F.coalesce(F.sum(c).over(w), zero) for w in sides), zero).alias(k) for k, c in (("sx", dx), ("sy", dy), ("sxx", dx * dx), ("sxy", dx * dy))}
    ends = [F.sum((F.col("x") == F.col(c)).cast("long")).over(g).alias(f"at_{c}") for c in ("lo", "hi")]
    p = p.select("*", *others.values(), *ends)
    m = F.col("n") - 1
    rest_x, rest_y = F.try_divide(F.col("sx"), m), F.try_divide(F.col("sy"), m)
    slope = F.try_divide(F.col("sxy") - F.col("sx") * rest_y, F.col("sxx") - F.col("sx") * rest_x)
    # The others may all have one x: then their line is the least-norm one.
    flat = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when((F.col("x") == F.col("lo")) & (F.col("at_hi") == m), F.col("hi")).when(
        (F.col("x") == F.col("hi")) & (F.col("at_lo") == m), F.col("lo"))
    mean_y = rest_y + F.col("cy")
    value = F.when(flat.isNotNull(), mean_y / 2 * (F.col("x") / flat + 1)).otherwise(mean_y + slope * (F.col("x") - F.col("cx") - rest_x))
    return _residuals(p, back(value), method)


def loo_scale(points: DataFrame) -> DataFrame:
    """Scales refitted without each point, from sums over the points before and behind it; nothing is subtracted."""
    g = W.partitionBy("group_key")
    x, y = F.col("pred"), F.col("gt_m")
    p = clean(points).select("group_key", "pred", "gt_m", F.count("*").over(g).alias("n"), F.row_number().over(g.orderBy("pred", "gt_m")).alias("i"))
    sides = [g.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.col("i"), F.col("i").desc())]
    p = p.select("*", *(sum((F.coalesce(F.sum(c).over(w), F.lit(0.0)) for w in sides), F.lit(0.0)).alias(k) for k, c in (("sxy", x * y), ("sxx", x * x))))
    return _residuals(p, F.try_divide(F.col("sxy"), F.col("sxx")) * x, "scale")


def loo_scale_robust(points: DataFrame) -> DataFrame:
    """Median ratios of the other points: the middle ones of the group's ratios in order, one place on where the point
    left out stands at or before them."""
    g = W.partitionBy("group_key")
    p = clean(points).select("group_key", "pred", "gt_m", (F.col("gt_m") / F.col("pred")).alias("ratio"), F.count("*").over(g).alias("n"))
    p = p.select("*", F.row_number().over(g.orderBy("ratio", "pred", "gt_m")).alias("i"))
    low = F.floor(F.col("n") / 2)  # places of the middle ones among n - 1 others, from 1
    high = F.floor((F.col("n") + 1) / 2)
    middle = {d: F.max(F.when(F.col("i") == low + d, F.col("ratio"))).over(g).alias(f"m{d}") for d in (0, 1, 2)}
    p = p.select("*", *middle.values())
    own = lambda place: F.when(F.col("i") <= place, place + 1).otherwise(place)
    value = lambda place: F.coalesce(*(F.when(own(place) == low + d, F.col(f"m{d}")) for d in (0, 1, 2)))
    return _residuals(p, (value(low) + value(high)) / 2 * F.col("pred"), "scale")


def _residuals(p: DataFrame, value: Column, method: str) -> DataFrame:
    scored = F.col("n") >= MIN_POINTS[method] + 1
    return p.select("group_key", "gt_m", F.abs(F.col("pred") - F.col("gt_m")).alias("err_uncal"), F.when(scored, F.abs(value - F.col("gt_m"))).alias("err_cal"))


def loo(points: DataFrame, method: str, degree: int = 2, robust: bool = False) -> DataFrame:
    """As :func:`loo_linear` for any method."""
    native = {("scale", False): loo_scale, ("scale", True): loo_scale_robust, ("linear", False): loo_linear, ("disparity", False): loo_disparity, ("disparity", True): loo_disparity}
    if (method, robust) in native:
        return native[method, robust](points)

    def run(own, edges):
        rows, _, refit = numeric.leave_one_out_groups(method, own["pred"], own["gt_m"], own["v"], edges, degree, robust)
        gt = own["gt_m"][rows]
        return {"group_key": own["group_key"][rows], "gt_m": gt, "err_uncal": np.abs(own["pred"][rows] - gt), "err_cal": [None if e != e else e for e in refit.tolist()]}

    rows = clean(points, rows=method == "poly2d").select("group_key", "pred", "gt_m", "v")
    return map_sorted(rows, run, "group_key string, gt_m double, err_uncal double, err_cal double")


def group_scores(residuals: DataFrame) -> DataFrame:
    """(group_key, n_points, loo_mae_uncal, loo_mae_cal, improvement) of each group."""
    out = residuals.groupBy("group_key").agg(F.count("*").alias("n_points"), F.avg("err_uncal").alias("loo_mae_uncal"), F.avg("err_cal").alias("loo_mae_cal"))
    return out.withColumn("improvement", F.col("loo_mae_uncal") - F.col("loo_mae_cal"))


def summary(scores: DataFrame) -> DataFrame:
    """Means over scored groups, each group counting the same, and how many groups improve."""
    ok = F.col("loo_mae_cal").isNotNull() & F.col("loo_mae_uncal").isNotNull()
    better = ok & (F.col("loo_mae_cal") < F.col("loo_mae_uncal"))
    out = scores.agg(F.count("*").alias("n_groups_total"), F.count_if(ok).alias("n_groups_scored"), F.avg(F.when(ok, F.col("loo_mae_uncal"))).alias("mean_loo_mae_uncal"),
                     F.avg(F.when(ok, F.col("loo_mae_cal"))).alias("mean_loo_mae_cal"), F.count_if(better).alias("n_groups_improved"))
    return out.withColumn("mean_improvement", F.col("mean_loo_mae_uncal") - F.col("mean_loo_mae_cal")).withColumn(
        "pct_groups_improved", F.try_divide(100.0 * F.col("n_groups_improved"), F.col("n_groups_scored")))


def bucket_columns(gt: Column, uncal: Column, cal: Column) -> list[Column]:
    """Counts and mean errors of scored points in each distance bucket."""
    out = []
    for name, lo, hi in BUCKETS:
        inside = (gt >= lo) & (gt < hi) & cal.isNotNull()
        out += [F.count_if(inside).alias(f"{name}_n"), F.avg(F.when(inside, uncal)).alias(f"{name}_mae_uncal"), F.avg(F.when(inside, cal)).alias(f"{name}_mae_cal")]
    return out


def buckets(residuals: DataFrame) -> DataFrame:
    under = (F.col("gt_m") < 1) & F.col("err_cal").isNotNull()
    return residuals.agg(*bucket_columns(F.col("gt_m"), F.col("err_uncal"), F.col("err_cal")), F.count_if(under).alias("below_1m_n"))
