"""Domain tables derived from the driver's tables, as DataFrames and as DuckDB SQL of the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VIDEO = "concat('site', cast({k} % 5 AS string), '_cam', cast({k} % 50 AS string), '_DSCF', cast({k} AS string))"
_PATH = "concat('site', cast({k} % 5 AS string), '/cam', cast({k} % 50 AS string), '/DSCF', cast({k} AS string), '.AVI')"
_L, _O = _VIDEO.format(k="l_orderkey"), _VIDEO.format(k="o_orderkey")

ANNOTATIONS = f"""{_L} AS video_name,
  cast(floor(l_linenumber * 2.04e0 * (24 + l_orderkey % 3) + 0.5e0) AS int)
    + CASE WHEN l_partkey % 11 = 0 THEN 3 WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS frame_idx;
  l_linenumber * 2.04e0 AS frame_timestamp;
  CASE WHEN l_suppkey % 97 = 0 THEN 401e0 WHEN l_suppkey % 89 = 1 THEN 0e0 ELSE l_quantity END AS distance"""
RESULTS = f"""{_L} AS video_name;
  l_linenumber * 25 AS frame_idx;
  l_linenumber * 1.0e0 AS frame_timestamp;
  l_quantity AS distance_gt;
  CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE cast(l_partkey % 2 AS int) END AS instance_idx;
  CASE WHEN l_suppkey % 19 = 0 THEN 'empty_mask' WHEN l_suppkey % 23 = 0 THEN 'depth_error: no depth map' ELSE 'processed' END AS status;
  CASE WHEN l_suppkey % 19 = 0 OR l_suppkey % 23 = 0 THEN NULL ELSE l_quantity * 0.8e0 + l_extendedprice / 9973e0 END AS depth_mask_mean;
  CASE WHEN l_suppkey % 19 = 0 OR l_suppkey % 23 = 0 THEN NULL ELSE l_quantity * 0.9e0 + l_extendedprice / 19937e0 END AS depth_centroid;
  l_discount * 9.7e0 + 0.011e0 AS center_y_norm"""
VIDEO_FPS = f"""{_O} AS video_name;
  {_PATH.format(k="o_orderkey")} AS path;
  cast(24 + o_orderkey % 3 AS double) AS fps;
  cast(24 + o_orderkey % 3 AS double) - CASE WHEN o_orderkey % 17 = 0 THEN 0.5e0 ELSE 0e0 END AS avg_fps;
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE cast(8 + o_custkey % 10 AS double) END AS duration_s;
  o_orderkey % 17 = 0 AS vfr"""
ANNOTATIONS = ANNOTATIONS.replace("AS video_name,", "AS video_name;")

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _exprs(text: str) -> list[str]:
    return [x.strip() for x in text.split(";")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with ``ord``, the file order."""
    return read(spark, sf_dir, "lineitem").selectExpr(*_exprs(ANNOTATIONS), f"struct({_ORDER}) AS ord")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*_exprs(RESULTS), f"struct({_ORDER}) AS ord")


def video_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderkey % 37 <> 0").selectExpr(*_exprs(VIDEO_FPS))


def video_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(f"{_PATH.format(k='o_orderkey')} AS ori", f"{_O} AS anno")


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose annotation is flagged, here those measured at 48 m or more."""
    return results(spark, sf_dir).where("distance_gt >= 48").select("video_name", "frame_idx").distinct()


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 depth map and mask for each embedding: frame_id, grp, h, w, depth, mask, distance_gt."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_id"), F.col("label").alias("grp"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.expr("transform(embedding, (e, i) -> CASE WHEN (vec_id + i) % 53 = 0 THEN double('NaN') ELSE 5e0 + 20e0 * cast(e AS double) END)").alias("depth"),
        F.expr("transform(embedding, (e, i) -> (i div 8) BETWEEN vec_id % 4 AND vec_id % 4 + 3 AND i % 8 BETWEEN vec_id % 5 AND vec_id % 5 + 3)").alias("mask"),
        F.expr("1e0 + (vec_id * 7 % 40) / 2e0").alias("distance_gt"))


def filed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each frame of :func:`frames`, its group as a camera; a third has no instance, a third the second one."""
    return frames(spark, sf_dir).selectExpr("concat('cam', cast(grp AS string)) AS group_key", "concat('cam', cast(grp AS string)) AS video_name", "cast(frame_id AS int) AS frame_idx",
                                            "CASE frame_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS instance_idx", "5e0 + (frame_id * 13 % 17) / 4e0 AS pred",
                                            "distance_gt AS gt_m", "0.5e0 AS v", "frame_id AS ord")


def map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of :func:`frames`, of which some are missing."""
    return frames(spark, sf_dir).where("frame_id % 7 <> 3").selectExpr("concat('cam', cast(grp AS string)) AS video_name", "cast(frame_id AS int) AS frame_idx", "h", "w", "depth")


def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks of :func:`frames` and, as a second instance, their complements, as run lengths; some files are missing."""
    from ..operators.maps import encode_masks

    size = F.array("h", "w")
    both = frames(spark, sf_dir).where("frame_id % 11 <> 5").withColumns({"c0": encode_masks(size, F.col("mask")), "c1": encode_masks(size, F.transform("mask", lambda m: ~m))})
    one = [F.struct(F.lit(k).alias("instance_idx"), F.struct(size.alias("size"), F.col(f"c{k}").alias("counts")).alias("rle")) for k in (0, 1)]
    return both.select(F.concat(F.lit("cam"), F.col("grp").cast("string")).alias("video_name"), F.col("frame_id").cast("int").alias("frame_idx"), F.array(*one).alias("instances"))


def _select(text: str, source: str) -> str:
    return f"SELECT {', '.join(_exprs(text))} FROM {source}"


_ROW = f"row_number() OVER (ORDER BY {_ORDER}) - 1 AS row_id"

#: Common table expressions of the views for DuckDB, by name.
CTES = {
    "f_annotations": f"SELECT {_ROW}, {', '.join(_exprs(ANNOTATIONS))} FROM lineitem",
    "f_video_fps": _select(VIDEO_FPS, "orders WHERE o_orderkey % 37 <> 0"),
    "f_video_list": f"SELECT {_PATH.format(k='o_orderkey')} AS ori, {_O} AS anno FROM orders",
    "f_results": f"SELECT {_ROW}, {', '.join(_exprs(RESULTS))} FROM lineitem",
    "f_pixels": """SELECT vec_id AS frame_id, label AS grp, pos,
       CASE WHEN (vec_id + pos) % 53 = 0 THEN cast('NaN' AS double) ELSE 5e0 + 20e0 * cast(e AS double) END AS depth,
       cast(floor(pos / 8) AS int) BETWEEN vec_id % 4 AND vec_id % 4 + 3 AND pos % 8 BETWEEN vec_id % 5 AND vec_id % 5 + 3 AS in_mask,
       1e0 + (vec_id * 7 % 40) / 2e0 AS distance_gt
FROM (SELECT vec_id, label, unnest(range(0, 64)) AS pos, unnest(embedding) AS e FROM embeddings)""",
    "f_filed": """SELECT *, CASE WHEN instance = 1 THEN NOT in_mask ELSE in_mask END AS subject FROM (SELECT *, CASE frame_id % 3 WHEN 2 THEN 1 ELSE 0 END AS instance,
       frame_id % 7 <> 3 AND frame_id % 11 <> 5 AS there FROM f_pixels)""",
    "f_exclusions": "SELECT DISTINCT video_name, frame_idx FROM f_results WHERE distance_gt >= 48",
}
