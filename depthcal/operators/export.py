"""Pairing of calibrated maps with their frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parse_frame_file


def list_calibrated(paths: DataFrame) -> DataFrame:
    """(path, video_name, frame_idx) of the paths that name a calibrated map; others are skipped."""
    video, frame = parse_frame_file(F.col("path"))
    return paths.select("path", video.alias("video_name"), frame.alias("frame_idx")).where("video_name <> '' and frame_idx is not null")


def export_pairs(maps: DataFrame, frames: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Maps and decoded frames one to one; a map without a frame, or excluded, has no pair."""
    if exclusions is not None:
        maps = maps.join(exclusions.select("video_name", "frame_idx").distinct(), ["video_name", "frame_idx"], "left_anti")
    return maps.dropDuplicates(["video_name", "frame_idx"]).join(frames.dropDuplicates(["video_name", "frame_idx"]), ["video_name", "frame_idx"])
