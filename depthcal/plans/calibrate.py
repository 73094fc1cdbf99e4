"""Calibration from end to end: points, alignment on maps and masks, fits, leave-one-out, calibrated maps and the report."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.grouped import map_groups
from ..functions.scalar import frame_file
from ..operators.align import BROADCAST_BYTES, MIN_BACKGROUND, pick_reference
from ..operators.maps import decode_masks, resize_cubic, resize_nearest_array
from ..operators.points import KEY

FRAME = KEY[:2]
ALIGNMENTS = ("none", "ransac", "least_squares")
_REFERENCE = "align_ref_video string, align_ref_frame_idx int, align_ref_instance_idx int"


def attach_files(points: DataFrame, maps: DataFrame, masks: DataFrame) -> DataFrame:
    """Points with the map of their frame (h, w, depth) and the mask of their instance (size, mask), null where a file
    has none. ``maps``: FRAME, h, w, depth; ``masks``: FRAME, instances of (instance_idx, rle). A point without an
    instance takes the first one of its file."""
    own = F.when(F.col("instance_idx").isNull(), F.get("instances", 0)).otherwise(F.get(F.filter("instances", lambda m: m["instance_idx"] == F.col("instance_idx")), 0))
    out = points.join(maps.select(*FRAME, "h", "w", "depth"), FRAME, "left").join(masks.select(*FRAME, "instances"), FRAME, "left")
    out = out.withColumn("rle", own["rle"]).drop("instances")
    return out.withColumns({"size": F.col("rle.size"), "mask": decode_masks(F.col("rle.size"), F.col("rle.counts"))}).drop("rle")


def _value(align: str, is_ref: bool, depth, mask, ref_depth, ref_mask) -> float | None:
    """The subject's median on the reference's scale; maps come on the grid of the reference's mask."""
    ref_depth, depth = resize_cubic(ref_depth, ref_mask.shape), resize_cubic(depth, ref_mask.shape)
    mask = resize_nearest_array(mask, ref_mask.shape)
    a, b = 1.0, 0.0
    ground = ~mask & ~ref_mask & np.isfinite(depth) & np.isfinite(ref_depth)
    if not is_ref and ground.sum() >= MIN_BACKGROUND:
        x, y = depth[ground].astype(float), ref_depth[ground].astype(float)
        a, b = numeric.robust_affine(x, y) if align == "ransac" else numeric.line(x, y)
    inside = a * depth[mask & np.isfinite(depth)].astype(float) + b
    return float(np.median(inside)) if len(inside) else None


def align_points(points: DataFrame, maps: DataFrame | None, masks: DataFrame | None, align: str = "none", reference: str = "furthest",
                 min_points: int = 4, order: str = "ord") -> DataFrame:
    """Points (KEY, group_key, pred, gt_m, v and an order) with predictions aligned to their group's reference, and with
    align_applied and the reference's key.

    A group below ``min_points``, or whose reference has no map or mask, keeps its predictions; so does a point without
    them, or without a finite pixel under its mask.
    """
    if align not in ALIGNMENTS:
        raise ValueError(f"unknown alignment {align}")
    if align == "none":
        return points.selectExpr("*", "false AS align_applied", *(f"cast(null AS {kind.split()[1]}) AS {kind.split()[0]}" for kind in _REFERENCE.split(", ")))
    if maps is None or masks is None:
        raise ValueError("alignment needs maps and masks")
    enough = points.groupBy("group_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_points).select("group_key")
    chosen = pick_reference(points, reference, "group_key", "gt_m", order).join(enough, "group_key", "left_semi")
    filed = attach_files(points, maps, masks)
    marked = filed.join(chosen.withColumnRenamed("group_key", "_g"), (F.col("group_key") == F.col("_g")) & (F.col(order) == F.col("reference")), "left_semi")
    refs = marked.where("depth is not null and mask is not null").select(
        "group_key", F.col(order).alias("_ref"), F.col("video_name").alias("align_ref_video"), F.col("frame_idx").cast("int").alias("align_ref_frame_idx"),
        F.col("instance_idx").cast("int").alias("align_ref_instance_idx"), *(F.col(c).alias(f"r_{c}") for c in ("h", "w", "depth", "size", "mask")))
    held = refs.agg(F.sum(4 * F.size("r_depth") + F.size("r_mask"))).first()[0] or 0
    joined = filed.join(F.broadcast(refs) if held <= BROADCAST_BYTES else refs, "group_key", "left")

    @F.pandas_udf("double")
    def value(own: pd.Series, h: pd.Series, w: pd.Series, depth: pd.Series, size: pd.Series, mask: pd.Series, rh: pd.Series, rw: pd.Series, rdepth: pd.Series,
              rsize: pd.Series, rmask: pd.Series) -> pd.Series:
        out = []
        for is_ref, *a in zip(own, h, w, depth, size, mask, rh, rw, rdepth, rsize, rmask, strict=True):
            if a[2] is None or a[4] is None or a[7] is None:
                out.append(None)
                continue
            grid = lambda x, shape, kind: np.asarray(x, kind).reshape([int(n) for n in shape])
            out.append(_value(align, bool(is_ref), grid(a[2], a[:2], np.float32), grid(a[4], a[3], bool), grid(a[7], a[5:7], np.float32), grid(a[9], a[8], bool)))
        return pd.Series(out, dtype=object)

    columns = ("h", "w", "depth", "size", "mask")
    aligned = value(F.coalesce(F.col(order) == F.col("_ref"), F.lit(False)), *columns, *(f"r_{c}" for c in columns))
    out = joined.withColumn("_value", aligned).withColumn("pred", F.coalesce("_value", "pred")).withColumn("align_applied", F.col("_ref").isNotNull())
    return out.drop("_value", "_ref", *columns, *(f"r_{c}" for c in columns))


def fit_rows(points: DataFrame, method: str, anchor: str, calib_level: str = "clip", align: str = "none", degree: int = 2, robust: bool = False) -> DataFrame:
    """One row for each group that can be fitted: its parameters, leave-one-out errors and alignment. One shuffle by group."""
    kind = ("group_key string, n_points long, params string, loo_mae_uncal double, loo_mae_cal double, improvement double, align_applied boolean, " + _REFERENCE)

    def run(key, own):
        v = own["v"] if method == "poly2d" else None
        try:
            params = numeric.fit(method, own["pred"], own["gt_m"], v, degree, robust)
        except ValueError:
            return {}
        gt, plain, refit = numeric.leave_one_out(method, own["pred"], own["gt_m"], v, degree, robust)
        uncal, cal = float(plain.mean()), None if refit is None else float(refit.mean())
        whole = lambda x: None if x is None or x != x else int(x)
        return {"group_key": [key], "n_points": [len(gt)], "params": [json.dumps(params)], "loo_mae_uncal": [uncal], "loo_mae_cal": [cal],
                "improvement": [None if cal is None else uncal - cal], "align_applied": [bool(own["align_applied"][0])], "align_ref_video": [own["align_ref_video"][0]],
                "align_ref_frame_idx": [whole(own["align_ref_frame_idx"][0])], "align_ref_instance_idx": [whole(own["align_ref_instance_idx"][0])]}

    names = ["group_key", "pred", "gt_m", "v", "align_applied", "align_ref_video", "align_ref_frame_idx", "align_ref_instance_idx"]
    fitted = map_groups(points.select(names), run, kind)
    return fitted.select(F.lit(calib_level).alias("calib_level"), "group_key", F.lit(method).alias("method"), F.lit(anchor).alias("anchor"), "n_points", "params",
                         "loo_mae_uncal", "loo_mae_cal", "improvement", F.lit(align).alias("align_method"), "align_applied", "align_ref_video", "align_ref_frame_idx",
                         "align_ref_instance_idx")


def calibrated_maps(points: DataFrame, fits: DataFrame, maps: DataFrame, method: str) -> DataFrame:
    """(name, h, w, depth) of the calibrated map of each frame that has points and a map, once for a frame."""
    frames = points.groupBy(*FRAME).agg(F.min("group_key").alias("group_key")).join(fits.select("group_key", "params"), "group_key")
    rows = frames.join(maps.select(*FRAME, "h", "w", "depth"), FRAME)

    @F.pandas_udf("array<float>")
    def run(params: pd.Series, h: pd.Series, w: pd.Series, depth: pd.Series) -> pd.Series:
        return pd.Series([numeric.apply_to_map(method, json.loads(p), np.asarray(d, float).reshape(a, b)).ravel() for p, a, b, d in zip(params, h, w, depth, strict=True)])

    return rows.select(frame_file(F.col("video_name"), F.col("frame_idx"), "calib.npy").alias("name"), "h", "w", run("params", "h", "w", "depth").alias("depth"))


def calibrate(points: DataFrame, method: str = "linear", anchor: str = "mask_mean", calib_level: str = "clip", maps: DataFrame | None = None,
              masks: DataFrame | None = None, align: str = "none", reference: str = "furthest", min_points: int = 4, degree: int = 2, robust: bool = False,
              fits_path: str | None = None, maps_folder: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The fit rows of grouped points and, given maps, the calibrated maps; both are written where a path is given."""
    from ..sources.files import write_csv, write_npy

    used = align_points(points, maps, masks, align, reference, min_points)
    fits = fit_rows(used, method, anchor, calib_level, align, degree, robust)
    done = None if maps is None else calibrated_maps(used, fits, maps, method)
    if fits_path:
        write_csv(fits, fits_path)
    if maps_folder and done is not None:
        write_npy(done, maps_folder).count()
    return fits, done
