"""Scalar expressions with the semantics the tools need where Spark's own differ."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def site_of(video_name: Column) -> Column:
    """Text before the first underscore."""
    return F.substring_index(video_name, "_", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]+$", "")


def flat_name(path: Column) -> Column:
    """A path without its suffix, slashes as underscores."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/", "_")


def frame_file(video_name: Column, frame_idx: Column, suffix: str) -> Column:
    return F.format_string(f"%s_frame%06d_{suffix}", video_name, frame_idx.cast("int"))


def parse_frame_file(path: Column) -> tuple[Column, Column]:
    """(video_name, frame_idx) of a calibrated map's path; an empty name where it doesn't match."""
    pattern = r"([^/]+)_frame(\d{6})_calib\.npy$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2).try_cast("int")


def nullable_float(text: Column) -> Column:
    """Blank and ``None`` are missing; anything else must be a number."""
    return F.when(text.isNull() | (text == "") | (text == "None"), None).otherwise(text.cast("double"))


def parse_rate(text: Column) -> Column:
    """A ratio of whole numbers such as ``30000/1001``, or a plain number; null where it is neither."""
    ratio = F.split(F.trim(text), "/")
    whole = F.try_divide(F.get(ratio, 0).try_cast("double"), F.get(ratio, 1).try_cast("double"))
    return F.when(text.rlike(r"^\s*[+-]?\d+/\d+\s*$"), whole).when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))


def is_variable_rate(fps: Column, average: Column) -> Column:
    return F.coalesce(F.abs(fps - average) > 0.01, F.lit(False))


def general_format(x: Column) -> Column:
    """``%g``: six significant digits without trailing zeros."""
    # Java's %g keeps the zeros and never drops the point.
    size = F.floor(F.log10(F.abs(x)))
    plain = F.format_string("%.6f", x)
    digits = [F.when(size == k, F.format_string(f"%.{max(0, 5 - k)}f", x)) for k in range(-4, 6)]
    text = F.coalesce(*digits, plain)
    fixed = F.when(F.instr(text, ".") > 0, F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    small = F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e")
    return F.when(x == 0, "0").when((size < -4) | (size >= 6), small).otherwise(fixed)


def is_usable(x: Column) -> Column:
    """Finite and positive. NaN compares as the largest value in Spark, so it is excluded first."""
    return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < INF)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INF)


def status_prefix(status: Column) -> Column:
    """Segmentation and depth errors collapse to their prefix; other statuses stay."""
    return F.when(status.startswith("sam_error:") | status.startswith("depth_error:"), F.substring_index(status, ":", 1)).otherwise(status)


def model_input_size(width: int, height: int, limit: int = 255_000, unit: int = 14) -> tuple[int, int]:
    """The largest grid of multiples of ``unit`` near the aspect ratio whose area is within ``limit``.

    The grid nearest the wanted size (half-even) gives up units in the order of their share of the wanted side, the
    outermost first and of equals the lower one, until it fits.
    """
    area = width * height
    wanted = [side * math.sqrt(limit / area) if area > 0 else float(side) for side in (width, height)]
    grid = [round(side / unit) for side in wanted]
    units = sorted(((k / wanted[axis], axis) for axis in (0, 1) for k in range(1, grid[axis] + 1)), reverse=True)
    given = np.cumsum([[0, 0], *([axis == 0, axis == 1] for _, axis in units)], axis=0)
    fits = ((grid - given).prod(1) * unit * unit <= limit).argmax()
    cols, rows = (grid - given[fits]).tolist()
    return unit * max(cols, 1), unit * max(rows, 1)
