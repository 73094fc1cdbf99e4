"""Calibration from end to end, its files, and the sinks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthcal.operators import evaluate, export, maps, qc
from depthcal.plans import calibrate as cal
from depthcal.sources import files

POINTS = "group_key string, video_name string, frame_idx int, instance_idx int, pred double, gt_m double, v double, ord int"
MASKS = "video_name string, frame_idx int, instances array<struct<instance_idx int, rle struct<size array<int>, counts string>>>"


def box(h, w, top, left, size):
    m = np.zeros((h, w), bool)
    m[top:top + size, left:left + size] = True
    return m


@pytest.fixture
def scene(spark):
    """Five frames of a camera, each on another scale, one on another grid; the third has no map."""
    rng = np.random.default_rng(1)
    base = rng.uniform(2, 12, (12, 16))
    points, depth, masks = [], [], []
    for k in range(5):
        m = box(12, 16, k, 2 * k, 5)
        truth = base.copy()
        truth[m] = 3 + 2 * k
        if k != 2:
            depth.append(("c", k, 12, 16, (truth / (1 + k)).ravel().tolist()))
        masks.append(("c", k, [(0, maps.encode_mask(~m)), (1, maps.encode_mask(m))]))
        points.append(("c", "c", k, 1, float(k + 1), float(3 + 2 * k), 0.5, k))
    masks = [(v, f, [(i, (rle["size"], rle["counts"])) for i, rle in found]) for v, f, found in masks]
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(depth, "video_name string, frame_idx int, h int, w int, depth array<double>"), spark.createDataFrame(masks, MASKS)


@pytest.mark.parametrize("align", ["ransac", "least_squares"])
def test_aligned_values_share_a_scale(scene, align):
    points, depth, masks = scene
    rows = {r["frame_idx"]: r for r in cal.align_points(points, depth, masks, align).collect()}
    # The furthest frame, the last, is at a fifth of the truth; so are the others after alignment, but for the one without a map.
    assert all(rows[k]["pred"] == pytest.approx((3 + 2 * k) / 5, rel=0.02) for k in (0, 1, 3, 4)) and rows[2]["pred"] == 3.0
    assert all(r["align_applied"] and r["align_ref_frame_idx"] == 4 and r["align_ref_instance_idx"] == 1 for r in rows.values())


def test_gate_missing_reference_and_first_instance(scene):
    points, depth, masks = scene
    for out in (cal.align_points(points, depth, masks, "ransac", min_points=6), cal.align_points(points, depth.where("frame_idx < 4"), masks, "ransac")):
        assert [(r["pred"], r["align_applied"], r["align_ref_video"]) for r in out.orderBy("frame_idx").collect()] == [(k + 1.0, False, None) for k in range(5)]
    nobody = points.withColumn("instance_idx", F.when(F.col("frame_idx") == 0, None).when(F.col("frame_idx") == 1, 9).otherwise(1))
    found = {r["frame_idx"]: r["mask"] for r in cal.attach_files(nobody, depth, masks).collect()}
    assert found[0] == (~box(12, 16, 0, 0, 5)).ravel().tolist() and found[1] is None
    with pytest.raises(ValueError):
        cal.align_points(points, None, None, "ransac")


def test_frames_of_another_grid_are_resized(scene):
    points, depth, masks = scene
    small = [(r["video_name"], r["frame_idx"], 6, 8, np.reshape(r["depth"], (12, 16))[::2, ::2].ravel().tolist()) for r in depth.collect()]
    small = points.sparkSession.createDataFrame(small, depth.schema)
    rows = cal.align_points(points, depth.where("frame_idx = 4").union(small.where("frame_idx < 4")), masks, "ransac").collect()
    assert all(np.isfinite(r["pred"]) for r in rows)


def test_calibrate_writes_fits_and_maps(spark, scene, tmp_path):
    points, depth, masks = scene
    unfit = spark.createDataFrame([("none", "none", 0, None, -1.0, 2.0, 0.5, 9)], POINTS)
    fits, done = cal.calibrate(points.union(unfit), "linear", maps=depth, masks=masks, align="ransac", fits_path=str(tmp_path / "fits"), maps_folder=str(tmp_path / "maps"))
    back = spark.read.csv(str(tmp_path / "fits"), header=True).collect()
    assert [r["group_key"] for r in back] == ["c"] and set(json.loads(fits.first()["params"])) == {"a", "b"}
    names = sorted(p.name for p in (tmp_path / "maps").iterdir())
    assert names == [f"c_frame{k:06d}_calib.npy" for k in (0, 1, 3, 4)] and done.count() == 4
    p, raw = json.loads(fits.first()["params"]), np.array(depth.where("frame_idx = 1").first()["depth"])
    want = p["a"] * raw + p["b"]
    assert np.allclose(np.load(tmp_path / "maps" / names[1]).ravel(), np.where(want > 0, want, np.nan), equal_nan=True, rtol=1e-5)


def test_mask_files_round_trip(spark, tmp_path):
    rle = maps.encode_mask(box(4, 5, 1, 1, 2))
    rows = [("v", 3, [([2, 2], 4, (rle["size"], rle["counts"])), ([1, 1], 2, (rle["size"], rle["counts"]))])]
    df = spark.createDataFrame(rows, "video_name string, frame_idx int, instances array<struct<center_xy array<int>, area_px int, rle struct<size array<int>, counts string>>>")
    assert files.write_masks(df, str(tmp_path)).collect()[0]["name"] == "v_frame000003_masks.json"
    back = files.read_masks(spark, str(tmp_path / "*.json")).first()["instances"]
    assert [(m["instance_idx"], m["area_px"]) for m in back] == [(0, 4), (1, 2)]


def test_paired_export_writes_both(spark, tmp_path):
    (tmp_path / "in").mkdir()
    np.save(tmp_path / "in" / "v_frame000003_calib.npy", np.ones((2, 2), np.float32))
    paths = spark.createDataFrame([(str(tmp_path / "in" / "v_frame000003_calib.npy"),), (str(tmp_path / "in" / "other.txt"),)], "path string")
    frames = spark.createDataFrame([("v", 3, 2, 2, [0.0, 255.0, 3.0, 4.0]), ("w", 1, 2, 2, [0.0] * 4)], "video_name string, frame_idx int, h int, w int, pixels array<double>")
    assert files.write_pairs(export.export_pairs(export.list_calibrated(paths), frames), str(tmp_path / "out")).count() == 1
    assert (tmp_path / "out" / "frames" / "v_frame000003.png").read_bytes()[1:4] == b"PNG"
    assert np.array_equal(np.load(tmp_path / "out" / "depth_maps" / "v_frame000003_calib.npy"), np.ones((2, 2)))


def test_last_row_device_and_flag_order(spark):
    videos = spark.createDataFrame([("v", "/z", 0), ("v", "/a", 1)], "anno string, ori string, row long")
    notes = spark.createDataFrame([("v",)], "video_name string")
    assert evaluate.resolve_videos(notes, videos).first()["path"] == "/a"
    assert evaluate.device_of("cpu") == "cpu" and evaluate.on_device(lambda f, device: device, "cpu")(None) == "cpu"
    with pytest.raises(ValueError):
        evaluate.device_of("tpu")
    flags = spark.createDataFrame([(1, qc.REASONS[4]), (0, qc.REASONS[3]), (1, qc.REASONS[0])], "ord int, reason string")
    assert [tuple(r) for r in qc.in_file_order(flags).collect()] == [(0, qc.REASONS[3]), (1, qc.REASONS[0]), (1, qc.REASONS[4])]
