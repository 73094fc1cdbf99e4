"""Evaluation: pluggable models, per-frame reduction, status counts and error metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import status_prefix
from .maps import center_row, in_mask, mask_geometry, mean_of, value_at

#: Frames of one video, (n, h, w) or (n, h, w, 3), to depth maps (n, h, w).
Backend = Callable[[np.ndarray], np.ndarray]


def synthetic_backend(frames: np.ndarray) -> np.ndarray:
    """A stand-in for a neural model: depth grows with brightness, scaled by the video's mean. Deterministic."""
    grey = frames.mean(axis=-1) if frames.ndim == 4 else frames.astype(float)
    return (1 + grey * (10 / (1 + grey.mean()))).astype(np.float32)


def device_of(choice: str = "auto") -> str:
    """The device that a model is to use: ``cpu``, ``cuda``, or for ``auto`` the latter where a worker has it."""
    if choice not in ("auto", "cpu", "cuda"):
        raise ValueError(f"unknown device {choice}")
    if choice != "auto":
        return choice
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "cpu"


def on_device(backend: Callable, choice: str = "auto") -> Backend:
    """A backend that takes ``device`` as a keyword, bound to the device of the worker that runs it."""
    device_of(choice)
    return lambda frames: backend(frames, device=device_of(choice))


def estimate_depth(frames: DataFrame, backend: Backend = synthetic_backend) -> DataFrame:
    """(video_name, frame_idx, h, w, depth, status) of frames (video_name, frame_idx, h, w, pixels), jointly for a video.

    A video's frames (at most a few dozen are annotated) go to one call; a failing call marks that video's rows only.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        try:
            stack = np.stack([np.asarray(p, float).reshape(h, w) for p, h, w in zip(pdf["pixels"], pdf["h"], pdf["w"], strict=True)])
            maps, status = list(backend(stack).reshape(len(pdf), -1)), "processed"
        except Exception as e:  # the error belongs to these rows
            maps, status = [None] * len(pdf), f"depth_error: {e}"
        return pd.DataFrame({"video_name": pdf["video_name"], "frame_idx": pdf["frame_idx"], "h": pdf["h"], "w": pdf["w"], "depth": maps, "status": status})

    kind = "video_name string, frame_idx int, h int, w int, depth array<float>, status string"
    return frames.groupBy("video_name").applyInPandas(run, kind)


def reduce_frames(frames: DataFrame) -> DataFrame:
    """One row for each instance of (video_name, frame_idx, h, w, depth, instances array<struct<instance_idx, mask>>)."""
    one = frames.select("video_name", "frame_idx", "h", "w", "depth", F.explode_outer("instances").alias("i"))
    one = one.withColumn("g", mask_geometry(F.col("i.mask"), F.col("w")))
    status = F.when(F.col("depth").isNull(), "depth_error: no depth map").when(F.col("g").isNull(), "empty_mask").otherwise("processed")
    return one.select("video_name", "frame_idx", F.col("i.instance_idx").alias("instance_idx"), status.alias("status"), F.col("g.area").alias("mask_area_px"),
                      mean_of(in_mask(F.col("depth"), F.col("i.mask"))).alias("depth_mask_mean"),
                      value_at(F.col("depth"), F.col("g.center_x"), F.col("g.center_y"), F.col("w")).alias("depth_centroid"),
                      F.col("g.center_x").alias("center_x"), F.col("g.center_y").alias("center_y"), center_row(F.col("g.center_y"), F.col("h")).alias("center_y_norm"))


def fan_out(annotations: DataFrame, reduced: DataFrame) -> DataFrame:
    """Every annotation with the results of its frame, at least once; frames without a result are marked."""
    out = annotations.join(reduced, ["video_name", "frame_idx"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("frame_decode_error")))


def resolve_videos(annotations: DataFrame, videos: DataFrame) -> DataFrame:
    """Annotations with the path of their video; ``video_missing`` where the list has none. The last of repeated names wins."""
    order = F.col("row") if "row" in videos.columns else F.col("ori")
    last = videos.where(F.col("anno").isNotNull()).groupBy("anno").agg(F.max_by("ori", order).alias("path"))
    out = annotations.join(last, annotations.video_name == last.anno, "left").drop("anno")
    return out.withColumn("status", F.when(F.col("path").isNull(), "video_missing"))


#: Makes a model once for each worker; the model turns a frame (h, w) into detected masks (h, w).
Segmenter = Callable[[], Callable[[np.ndarray], list[np.ndarray]]]


def synthetic_segmenter() -> Callable[[np.ndarray], list[np.ndarray]]:
    """A stand-in for a neural model: one mask of the pixels brighter than the frame's mean."""
    return lambda frame: [frame > frame.mean()]


def segment_frames(frames: DataFrame, segmenter: Segmenter = synthetic_segmenter) -> DataFrame:
    """(video_name, frame_idx, instances, seg_status): masks without pixels dropped, the others in the order of their center."""
    def centre(mask):
        x = np.flatnonzero(mask.any(0))
        return (x[0] + x[-1]) // 2

    def run(batches):
        model = segmenter()
        for pdf in batches:
            rows = []
            for video, k, h, w, pixels in zip(pdf["video_name"], pdf["frame_idx"], pdf["h"], pdf["w"], pdf["pixels"], strict=True):
                try:
                    found = sorted((m for m in model(np.asarray(pixels, float).reshape(int(h), int(w))) if m.any()), key=centre)
                    rows.append((video, k, [{"instance_idx": i, "mask": m.ravel().tolist()} for i, m in enumerate(found)], None))
                except Exception as e:  # the error belongs to this frame
                    rows.append((video, k, [], f"sam_error: {e}"))
            yield pd.DataFrame(rows, columns=["video_name", "frame_idx", "instances", "seg_status"])

    kind = "video_name string, frame_idx int, instances array<struct<instance_idx int, mask array<boolean>>>, seg_status string"
    return frames.select("video_name", "frame_idx", "h", "w", "pixels").mapInPandas(run, kind)


def evaluate_annotations(annotations: DataFrame, videos: DataFrame, decode, backend: Backend = synthetic_backend, segmenter: Segmenter = synthetic_segmenter) -> DataFrame:
    """Annotations (video_name, frame_idx, ...) to results: every annotation at least once, with a status.

    Videos are resolved, wanted frames decoded once, depth estimated once for a video, frames segmented once, and the
    results of a frame handed to all its annotations.
    """
    from ..sources.files import read_frames

    resolved = resolve_videos(annotations, videos)
    missing, present = resolved.where("path is null"), resolved.where("path is not null").drop("status")
    frames = read_frames(present.select("path", "frame_idx").distinct(), decode)
    frames = frames.join(present.select("path", "video_name").distinct(), "path")
    bad = frames.where("status is not null").select("video_name", "frame_idx", "status")
    good = frames.where("status is null")
    depth = estimate_depth(good, backend).select("video_name", "frame_idx", "h", "w", "depth", F.col("status").alias("depth_status"))
    both = depth.join(segment_frames(good, segmenter), ["video_name", "frame_idx"])
    failed = F.coalesce(F.when(F.col("depth_status") != "processed", F.col("depth_status")), F.col("seg_status"))
    errors = both.where(failed.isNotNull()).select("video_name", "frame_idx", failed.alias("status"))
    reduced = reduce_frames(both.where(failed.isNull()))
    results = reduced.unionByName(errors, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)
    return fan_out(present.drop("path"), results).unionByName(missing.drop("path"), allowMissingColumns=True)


def summary_line(metrics: dict) -> str:
    """The metrics of :func:`error_metrics` for a console."""
    return "n={n} MAE={mae:.3f} RMSE={rmse:.3f} bias={bias:+.3f} gt [{gt_min:.1f}, {gt_max:.1f}] pred [{pred_min:.1f}, {pred_max:.1f}]".format(**metrics)


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(status_prefix(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


def error_metrics(results: DataFrame) -> DataFrame:
    e = F.col("depth_mask_mean") - F.col("distance_gt")
    pairs = results.where((F.col("status") == "processed") & F.col("depth_mask_mean").isNotNull())
    return pairs.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.min("distance_gt").alias("gt_min"),
                     F.max("distance_gt").alias("gt_max"), F.min("depth_mask_mean").alias("pred_min"), F.max("depth_mask_mean").alias("pred_max"))
