"""Alignment of a group's frames to a reference frame on background pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.scalar import INF
from .maps import in_mask, median_of

MIN_BACKGROUND = 8
#: Bytes of reference maps and masks that may be broadcast; beyond it they are joined by group.
BROADCAST_BYTES = 64 << 20


def pick_reference(points: DataFrame, method: str = "furthest", group: str = "grp", distance: str = "distance_gt", order: str = "frame_id") -> DataFrame:
    """(group, reference): the furthest point, or the one nearest the median distance; the first of equals."""
    if method == "furthest":
        return points.groupBy(group).agg(F.min_by(order, F.struct(-F.col(distance), F.col(order))).alias("reference"))
    if method != "median":
        raise ValueError(f"unknown reference method {method}")
    middle = points.groupBy(group).agg(F.median(distance).alias("_m"))
    far = F.abs(F.col(distance) - F.col("_m"))
    return points.join(middle, group).groupBy(group).agg(F.min_by(order, F.struct(far, F.col(order))).alias("reference"))


def with_reference(frames: DataFrame, method: str = "furthest", chosen: DataFrame | None = None) -> DataFrame:
    """Each frame with its group's reference frame: reference, ref_depth, ref_mask. ``chosen``: (grp, reference) if given."""
    chosen = pick_reference(frames, method) if chosen is None else chosen
    ref = frames.join(chosen, (frames.frame_id == chosen.reference) & (frames.grp == chosen.grp), "left_semi")
    ref = ref.select("grp", F.col("frame_id").alias("reference"), F.col("depth").alias("ref_depth"), F.col("mask").alias("ref_mask"))
    # One map for each group: broadcast up to a size, so that a large group isn't gathered in one task.
    held = ref.agg(F.sum(8 * F.size("ref_depth") + F.size("ref_mask"))).first()[0] or 0
    return frames.join(F.broadcast(ref) if held <= BROADCAST_BYTES else ref, "grp")


def background(depth: Column, mask: Column, ref_depth: Column, ref_mask: Column) -> Column:
    """array of struct(x, y): pixels outside both masks that are finite in both maps; shapes must agree."""
    same = F.assert_true((F.size(depth) == F.size(ref_depth)) & (F.size(mask) == F.size(ref_mask)), "frames differ in shape")
    ok = lambda x: ~F.isnan(x) & (F.abs(x) < INF)
    pixels = F.arrays_zip(depth.alias("x"), ref_depth.alias("y"), mask.alias("m"), ref_mask.alias("r"))
    kept = F.filter(pixels, lambda p: ~p["m"] & ~p["r"] & ok(p["x"]) & ok(p["y"]))
    return F.when(same.isNull(), F.transform(kept, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))


def line_of(pixels: Column) -> Column:
    """struct(a, b, n): least squares of y on x over an array, from sums about the means; identity below eight pixels."""
    zero = F.lit(0.0)
    means = lambda p: F.aggregate(p, F.struct(zero.alias("x"), zero.alias("y")), lambda a, q: F.struct((a["x"] + q["x"]).alias("x"), (a["y"] + q["y"]).alias("y")))

    def about(p):
        n = F.size(p)
        m = F.struct((means(p)["x"] / n).alias("x"), (means(p)["y"] / n).alias("y"))
        return F.element_at(F.transform(F.array(m), lambda c: slope(p, n, c)), 1)

    def slope(p, n, c):
        sums = F.aggregate(p, F.struct(zero.alias("xx"), zero.alias("xy")), lambda a, q: F.struct(
            (a["xx"] + (q["x"] - c["x"]) * (q["x"] - c["x"])).alias("xx"), (a["xy"] + (q["x"] - c["x"]) * (q["y"] - c["y"])).alias("xy")))
        a = F.when(sums["xx"] > 0, sums["xy"] / sums["xx"]).otherwise(c["y"] / (2 * c["x"]))
        return F.struct(a.alias("a"), (c["y"] - a * c["x"]).alias("b"), n.alias("n"))

    identity = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n"))
    bound = lambda p: F.when(F.size(p) < MIN_BACKGROUND, F.struct(identity["a"].alias("a"), identity["b"].alias("b"), F.size(p).alias("n"))).otherwise(about(p))
    return F.element_at(F.transform(F.array(pixels), bound), 1)


def align_least_squares(frames: DataFrame, method: str = "furthest") -> DataFrame:
    """(frame_id, grp, reference, a, b, n): the line from each frame's background to its reference's."""
    joined = with_reference(frames, method)
    line = line_of(background(F.col("depth"), F.col("mask"), F.col("ref_depth"), F.col("ref_mask")))
    out = joined.select("frame_id", "grp", "reference", line.alias("f"))
    own = F.col("frame_id") == F.col("reference")
    return out.select("frame_id", "grp", "reference", F.when(own, 1.0).otherwise(F.col("f.a")).alias("a"), F.when(own, 0.0).otherwise(F.col("f.b")).alias("b"), F.col("f.n").cast("long").alias("n"))


def align_ransac(frames: DataFrame, method: str = "furthest", seeded: bool = False, trials: int = 200,
                 chosen: DataFrame | None = None) -> DataFrame:
    """As :func:`align_least_squares` by consensus of random pairs; ``seeded`` draws them from a seeded generator, else by
    arithmetic on the frame and the trial, which SQL can repeat."""
    joined = with_reference(frames, method, chosen)
    rows = joined.select("frame_id", "grp", "reference", background(F.col("depth"), F.col("mask"), F.col("ref_depth"), F.col("ref_mask")).alias("px"))
    rows = rows.select("frame_id", "grp", "reference", F.transform("px", lambda p: p["x"]).alias("x"), F.transform("px", lambda p: p["y"]).alias("y"))

    def line(frame, reference, x, y):
        x, y = np.asarray(x, float), np.asarray(y, float)
        if frame == reference or len(x) < MIN_BACKGROUND:
            return 1.0, 0.0
        if seeded:
            return numeric.robust_affine(x, y, trials)
        spread = np.ptp(y)
        return numeric.consensus(x, y, numeric.relational_pairs(int(frame), len(x), trials), 0.1 * spread if spread > 0 else 1.0)

    @F.pandas_udf("a double, b double")
    def fit(frame: pd.Series, reference: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([line(*r) for r in zip(frame, reference, x, y, strict=True)], columns=["a", "b"])

    out = rows.withColumn("f", fit("frame_id", "reference", "x", "y"))
    return out.select("frame_id", "grp", "reference", "f.a", "f.b", F.size("x").cast("long").alias("n"))


def aligned_subject(frames: DataFrame, lines: DataFrame) -> DataFrame:
    """(frame_id, value, status): median of the aligned finite depth under the mask; status where there is none."""
    joined = frames.join(lines.select("frame_id", "a", "b"), "frame_id")
    aligned = F.expr("transform(vals, d -> a * d + b)")
    out = joined.select("frame_id", "a", "b", in_mask(F.col("depth"), F.col("mask")).alias("vals")).withColumn("value", median_of(aligned))
    return out.select("frame_id", "value", F.when(F.col("value").isNull(), "no_finite_pixel").otherwise("aligned").alias("status"))


def align_groups(points: DataFrame, aligned: DataFrame, min_points: int = 4) -> DataFrame:
    """Points (group_key, frame_id, pred) whose prediction is the aligned value where the group has enough points."""
    sizes = points.groupBy("group_key").agg(F.count("*").alias("_n"))
    joined = points.join(sizes, "group_key").join(aligned.select("frame_id", "value"), "frame_id", "left")
    use = (F.col("_n") >= min_points) & F.col("value").isNotNull()
    return joined.withColumn("pred", F.when(use, F.col("value")).otherwise(F.col("pred"))).withColumn("align_applied", use).drop("_n", "value")
