"""Calibration points: filter, exclude, deduplicate, group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite, is_usable, parent_dir

ANCHORS = {"mask_mean": "depth_mask_mean", "centroid": "depth_centroid"}
KEY = ["video_name", "frame_idx", "instance_idx"]


def load_points(results: DataFrame, anchor: str = "mask_mean", exclusions: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Processed rows, without excluded frames, the first row of each (video, frame, instance) in file order.

    ``order`` is any sortable column of file order. The first row is found by a minimum, so it is pre-aggregated where
    the rows are read; only one row for each point is shuffled.
    """
    kept = results.where(F.col("status") == "processed")
    if exclusions is not None:
        kept = kept.join(exclusions.select("video_name", "frame_idx").distinct(), ["video_name", "frame_idx"], "left_anti")
    row = F.struct(F.col(ANCHORS[anchor]).alias("pred"), F.col("distance_gt").alias("gt_m"), F.col("center_y_norm").alias("v"))
    first = kept.groupBy(*KEY).agg(F.min_by(row, order).alias("p"))
    return first.select(*KEY, "p.pred", "p.gt_m", "p.v")


def by_clip(points: DataFrame) -> DataFrame:
    return points.withColumn("group_key", F.col("video_name"))


def by_camera(points: DataFrame, videos: DataFrame) -> DataFrame:
    """Group by the folder of the video; an unknown video is an error. The last of repeated names in ``videos`` wins."""
    keys = camera_keys(videos)
    joined = points.join(keys, points.video_name == keys.anno, "left")
    missing = F.assert_true(F.col("camera").isNotNull(), F.concat(F.lit("no path for video "), F.col("video_name")))
    return joined.select(*points.columns, F.coalesce(F.when(missing.isNull(), F.col("camera")), F.col("camera")).alias("group_key"))


def camera_keys(videos: DataFrame) -> DataFrame:
    """(anno, camera) of the video list."""
    order = F.col("row") if "row" in videos.columns else F.col("ori")
    last = videos.where(F.col("anno").isNotNull()).groupBy("anno").agg(F.max_by("ori", order).alias("ori"))
    return last.select("anno", parent_dir(F.col("ori")).alias("camera"))


def grouped_by(points: DataFrame, key: Column) -> DataFrame:
    """Group by any expression."""
    return points.withColumn("group_key", key)


def limit_groups(points: DataFrame, n: int) -> DataFrame:
    """The points of the first ``n`` groups in the order of their keys."""
    first = points.select("group_key").distinct().orderBy("group_key").limit(n)
    return points.join(F.broadcast(first) if n <= 100_000 else first, "group_key", "left_semi")


def clean(points: DataFrame, rows: bool = False) -> DataFrame:
    """Usable points: prediction and distance finite and positive, and the row coordinate finite where it is used."""
    ok = is_usable(F.col("pred")) & is_usable(F.col("gt_m"))
    return points.where(ok & is_finite(F.col("v")) if rows else ok)
