"""Annotation quality: flags, repair, summaries. Rules look at single rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import general_format, site_of

REASONS = ("VIDEO_NOT_ON_DISK", "FRAME_IDX_FPS_MISMATCH", "TIMESTAMP_PAST_END", "ABSURD_DISTANCE", "ZERO_DISTANCE")
DISQUALIFYING = ("ABSURD_DISTANCE", "ZERO_DISTANCE")
DEFAULT_FPS = 24


def number_rows(df: DataFrame, order: str, block: Column, name: str = "row_id") -> DataFrame:
    """0-based numbers in the order of ``order``, of which ``block`` must be a monotone coarsening.

    Rows are numbered within blocks and raised by the counts of earlier blocks, so no single task sorts all rows.
    """
    rows = df.withColumn("_block", block)
    counts = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = counts.select("_block", F.coalesce(F.sum("_n").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("_block").orderBy(order)) - 1
    return rows.withColumn("_within", within).join(before, "_block").withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_block", "_before", "_within")


def with_fps(annotations: DataFrame, fps: DataFrame, *columns: str) -> DataFrame:
    """Left join on video_name; a repeated name in the dimension is an error."""
    dim = fps.groupBy("video_name").agg(*(F.first(c).alias(f"_{c}") for c in ("fps", "duration_s")), F.count("*").alias("_c"))
    unique = F.assert_true(F.col("_c") == 1, F.concat(F.lit("repeated video "), F.col("video_name")))
    dim = dim.where(F.coalesce(unique.isNull(), F.lit(True))).drop("_c")
    return annotations.join(dim, "video_name", "left")


def rules(max_distance: float) -> list[tuple[str, Column, Column]]:
    """(reason, condition, detail) over annotation columns and the joined _fps, _duration_s."""
    on_disk = F.col("_fps").isNotNull()
    expected = F.rint(F.col("frame_timestamp") * F.col("_fps"))
    return [
        (REASONS[0], ~on_disk, F.lit("")),
        (REASONS[1], on_disk & (F.abs(F.col("frame_idx") - expected) > 1),
         F.concat(F.lit("expected frame_idx "), expected.cast("long").cast("string"), F.lit(" at fps "), general_format(F.col("_fps")))),
        (REASONS[2], on_disk & F.col("_duration_s").isNotNull() & (F.col("frame_timestamp") > F.col("_duration_s") + 0.5),
         F.concat(F.lit("video duration "), F.format_string("%.1fs", F.col("_duration_s")))),
        (REASONS[3], ~F.isnan("distance") & (F.col("distance") > max_distance), F.lit("")),
        (REASONS[4], F.col("distance") <= 0, F.lit("")),
    ]


def collect_flags(annotations: DataFrame, fps: DataFrame, max_distance: float = 100.0) -> DataFrame:
    """One row for each annotation and reason, in a single pass over the annotations."""
    joined = with_fps(annotations, fps)
    found = F.array(*(F.when(cond, F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))) for reason, cond, detail in rules(max_distance)))
    return joined.select(*annotations.columns, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(*annotations.columns, "f.reason", "f.detail")


def in_file_order(flags: DataFrame, order: str = "ord") -> DataFrame:
    """Flags in the order of their rows, those of one row in the order of the rules."""
    return flags.orderBy(order, F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")))


def apply_fixes(annotations: DataFrame, fps: DataFrame, max_distance: float = 100.0, mode: str = "nan") -> DataFrame:
    """Annotations without disqualified rows, frame_idx from the timestamp where the video is known.

    Elsewhere it is null, or in mode ``estimate`` taken at 24 frames a second and marked so. Disqualifying rules look at
    the row alone, so they are a filter here rather than a join with the flags.
    """
    drop = [cond for reason, cond, _ in rules(max_distance) if reason in DISQUALIFYING]
    joined = with_fps(annotations, fps).where(~F.coalesce(drop[0] | drop[1], F.lit(False)))
    on_disk = F.col("_fps").isNotNull()
    estimate = F.rint(F.col("frame_timestamp") * DEFAULT_FPS) if mode == "estimate" else F.lit(None)
    frame = F.when(on_disk, F.rint(F.col("frame_timestamp") * F.col("_fps"))).otherwise(estimate).cast("long")
    estimated = ~on_disk if mode == "estimate" else F.lit(False)
    return joined.select(*(frame.alias(c) if c == "frame_idx" else F.col(c) for c in annotations.columns), estimated.alias("frame_idx_estimated"))


def counts_by_reason(flags: DataFrame) -> DataFrame:
    return flags.groupBy("reason").agg(F.count("*").alias("n"))


def counts_by_site(flags: DataFrame) -> DataFrame:
    return flags.groupBy(site_of(F.col("video_name")).alias("site")).agg(F.count("*").alias("n"))


def distinct_counts(flags: DataFrame, row: str = "row_id") -> DataFrame:
    return flags.agg(F.count_distinct(row).alias("n_rows"), F.count_distinct("video_name").alias("n_videos"), F.count("*").alias("n_flags"))


def plausible_outliers(annotations: DataFrame, max_distance: float = 100.0, over: float = 30.0) -> DataFrame:
    return annotations.where((F.col("distance") > over) & (F.col("distance") <= max_distance))


def missing_timestamps(annotations: DataFrame, export: DataFrame) -> DataFrame:
    """Annotations whose (video, timestamp) the export lacks."""
    return annotations.join(export.select("video_name", "frame_timestamp"), ["video_name", "frame_timestamp"], "left_anti")


def fps_histogram(fps: DataFrame) -> DataFrame:
    return fps.groupBy("fps").agg(F.count("*").alias("n"), F.count_if("vfr").alias("n_vfr"))
