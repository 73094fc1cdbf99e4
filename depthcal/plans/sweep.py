"""Sweep over anchors, alignments, reference frames, methods, degrees and robustness, by clip or camera, and its ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.grouped import map_sorted
from ..operators.align import align_groups, align_ransac, aligned_subject, pick_reference
from ..operators.loo import BUCKETS
from ..operators.points import KEY, by_camera, by_clip, load_points

ROBUST = ("scale", "linear")


def grid(anchors=("mask_mean", "centroid"), methods=numeric.METHODS, degrees=(1, 2, 3), aligns=("none",),
         ref_frame_methods=("furthest",)) -> list[tuple[str, str, str | None, str, int | None, bool | None]]:
    """(anchor, align, reference method, method, degree, robust): reference methods only for ransac, degrees only for
    poly, robustness only for scale and linear."""
    out = []
    for anchor in anchors:
        for align in aligns:
            for reference in ref_frame_methods if align == "ransac" else (None,):
                for method in methods:
                    for degree in degrees if method == "poly" else (None,):
                        out += [(anchor, align, reference, method, degree, robust) for robust in ((False, True) if method in ROBUST else (None,))]
    return out


def grid_frame(spark: SparkSession, **options) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(grid(**options))], "sweep_ord int, anchor string, align string, "
                                 "ref_frame_method string, method string, degree int, robust boolean")


def aligned_points(points: DataFrame, maps: DataFrame, reference: str, min_points: int = 4) -> DataFrame:
    """``points`` with predictions aligned within their groups; ``maps``: KEY, depth, mask, of one shape in a group.

    The reference is picked from all points. A point without a map keeps its prediction, as does a group whose
    reference has none.
    """
    points = points.withColumn("frame_id", F.format_string("%s/%012d/%012d", *KEY))
    chosen = pick_reference(points, reference, "group_key", "gt_m").withColumnRenamed("group_key", "grp")
    frames = points.join(maps.select(*KEY, "depth", "mask"), KEY).where("depth is not null and mask is not null").select(
        "frame_id", F.col("group_key").alias("grp"), "depth", "mask")
    values = aligned_subject(frames, align_ransac(frames, seeded=True, chosen=chosen))
    return align_groups(points, values, min_points)


def sweep(results: DataFrame, exclusions: DataFrame | None = None, maps: DataFrame | None = None, videos: DataFrame | None = None,
          calib_level: str = "clip", min_points: int = 4, **options) -> DataFrame:
    """One row for each combination. The points of all anchors and alignments share one shuffle by group; each group is
    scored by all combinations where it lies, and only its sums travel on. Alignment by ransac needs ``maps`` (KEY, depth,
    mask), the camera level (``cam``) needs ``videos``."""
    if calib_level not in ("clip", "cam") or calib_level == "cam" and videos is None:
        raise ValueError("calib_level is clip, or cam with a list of videos")
    combos = list(enumerate(grid(**options)))
    points = None
    for anchor, align, reference in sorted({c[:3] for _, c in combos}, key=str):
        p = load_points(results, anchor, exclusions)
        p = by_camera(p, videos) if calib_level == "cam" else by_clip(p)
        if align == "ransac":
            if maps is None:
                raise ValueError("alignment by ransac needs maps")
            p = aligned_points(p, maps, reference, min_points)
        elif align != "none":
            raise ValueError(f"unknown alignment {align}")
        p = p.select("group_key", "pred", "gt_m", "v", F.lit(f"{anchor}/{align}/{reference}").alias("loaded"))
        points = p if points is None else points.union(p)

    def run(points, edges):
        out: dict[str, list] = {n: [] for n in names}
        for ord_, (anchor, align, reference, method, degree, robust) in combos:
            use = np.flatnonzero(points["loaded"] == f"{anchor}/{align}/{reference}")
            x, y, v = (points[c][use] for c in ("pred", "gt_m", "v"))
            bounds = np.searchsorted(use, edges)
            rows, of, refit = numeric.leave_one_out_groups(method, x, y, v, bounds, degree or 2, bool(robust))
            plain, gt, n = np.abs(x[rows] - y[rows]), y[rows], len(edges) - 1
            sizes, scored = np.bincount(of, minlength=n), np.zeros(n, bool)
            scored[of[~np.isnan(refit)]] = True
            total = lambda value: np.bincount(of, value, n)  # noqa: B023, E731
            columns = {"uncal": total(plain) / np.maximum(sizes, 1), "cal": total(refit) / np.maximum(sizes, 1)}
            for name, lo, hi in BUCKETS:
                inside = (gt >= lo) & (gt < hi)
                columns |= {f"{name}_n": total(inside).astype(np.int64), f"{name}_u": total(plain * inside), f"{name}_c": total(refit * inside)}
            there = np.flatnonzero(np.diff(bounds))
            out["sweep_ord"].extend([ord_] * len(there))
            out["scored"].extend(scored[there].tolist())
            for c, value in columns.items():
                out[c].extend(a if ok else (0 if c.endswith("_n") else None) for a, ok in zip(value[there].tolist(), scored[there].tolist(), strict=True))
        return out

    kind = "sweep_ord int, scored boolean, uncal double, cal double, " + ", ".join(f"{b[0]}_n long, {b[0]}_u double, {b[0]}_c double" for b in BUCKETS)
    names = [x.split()[0] for x in kind.split(", ")]
    # Missing values are NaN to numpy, and so unusable.
    scores = map_sorted(points, run, kind)
    means = scores.groupBy("sweep_ord").agg(
        F.count("*").alias("n_groups_total"), F.count_if("scored").alias("n_groups_scored"), F.avg(F.when(F.col("scored"), F.col("uncal"))).alias("mean_loo_mae_uncal"),
        F.avg(F.when(F.col("scored"), F.col("cal"))).alias("mean_loo_mae_cal"), F.count_if(F.col("scored") & (F.col("cal") < F.col("uncal"))).alias("better"),
        *(F.sum(F.when(F.col("scored"), F.col(f"{b[0]}_n")).otherwise(0)).alias(f"{b[0]}_n") for b in BUCKETS),
        *(F.sum(F.when(F.col("scored"), F.col(f"{b[0]}_{k}"))).alias(f"_{b[0]}_{k}") for b in BUCKETS for k in "uc"))
    out = grid_frame(results.sparkSession, **options).join(means, "sweep_ord", "left")
    columns = []
    for name, _, _ in BUCKETS:
        columns += [F.coalesce(f"{name}_n", F.lit(0)).alias(f"{name}_n")]
        columns += [F.try_divide(F.col(f"_{name}_{k}"), F.col(f"{name}_n")).alias(f"{name}_mae_{label}") for k, label in (("u", "uncal"), ("c", "cal"))]
    return out.select("sweep_ord", "anchor", "align", F.coalesce("ref_frame_method", F.lit("")).alias("ref_frame_method"), F.lit(calib_level).alias("calib_level"),
                      "method", "degree", "robust", F.coalesce("n_groups_total", F.lit(0)).alias("n_groups_total"),
                      F.coalesce("n_groups_scored", F.lit(0)).alias("n_groups_scored"), "mean_loo_mae_uncal", "mean_loo_mae_cal",
                      (F.col("mean_loo_mae_uncal") - F.col("mean_loo_mae_cal")).alias("mean_improvement"),
                      F.try_divide(100.0 * F.col("better"), F.col("n_groups_scored")).alias("pct_groups_improved"), *columns)


def ranked(swept: DataFrame, by: str = "improvement", n: int = 15) -> DataFrame:
    """The best ``n`` combinations by improvement or by calibrated error, missing values last, then in sweep order.

    A calibrated error of exactly 0 ranks as what it is, the best.
    """
    key = F.desc_nulls_last("mean_improvement") if by == "improvement" else F.asc_nulls_last("mean_loo_mae_cal")
    return swept.orderBy(key, "sweep_ord").limit(n)
