"""The row-local quality rules over a stream of annotations. An extension: the batch tools have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import qc


def flag_stream(annotations: DataFrame, fps: DataFrame, max_distance: float = 100.0) -> DataFrame:
    """Flags of a streaming DataFrame against a static table of frame rates."""
    return qc.collect_flags(annotations, fps, max_distance)


def repair_stream(annotations: DataFrame, fps: DataFrame, max_distance: float = 100.0, mode: str = "nan") -> DataFrame:
    return qc.apply_fixes(annotations, fps, max_distance, mode)


def first_points(points: DataFrame, arrived: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each point within the watermark."""
    return points.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(["video_name", "frame_idx", "instance_idx"])
