"""Explicit schemas of the files; nothing is inferred."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    out = T.StructType()
    for part in text.split():
        name, _, kind = part.partition(":")
        out.add(name, {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType()}[kind])
    return out


ANNOTATIONS = _struct("video_name:s frame_idx:i frame_timestamp:d distance:d")
VIDEO_FPS = _struct("video_name:s path:s fps:d avg_fps:d duration_s:d nb_frames:s vfr:b")
RESULTS = _struct("video_name:s frame_idx:i frame_timestamp:d distance_gt:d depth_model:s instance_idx:i status:s "
                  "mask_area_px:i depth_mask_mean:d depth_centroid:d center_x:i center_y:i center_y_norm:d")
FITS = _struct("calib_level:s group_key:s method:s anchor:s n_points:l params:s loo_mae_uncal:d loo_mae_cal:d improvement:d "
               "align_method:s align_applied:b align_ref_video:s align_ref_frame_idx:i align_ref_instance_idx:i")
FLAGS = _struct("row:l video_name:s frame_idx:i frame_timestamp:d distance:d reason:s detail:s")
EXCLUSIONS = _struct("video_name:s frame_idx:i")
VIDEO_LIST = _struct("ori:s anno:s")

MASKS = T.ArrayType(T.StructType([
    T.StructField("instance_idx", T.IntegerType()),
    T.StructField("center_xy", T.ArrayType(T.IntegerType())),
    T.StructField("area_px", T.IntegerType()),
    T.StructField("rle", T.StructType([T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("counts", T.StringType())])),
]))
DEPTH_MAPS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()),
    T.StructField("depth", T.ArrayType(T.FloatType())),
])
