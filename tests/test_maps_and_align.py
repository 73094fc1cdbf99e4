import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from depthcal.functions import numeric, scalar
from depthcal.operators import align, evaluate, export, maps, qc
from depthcal.sources import files
from depthcal.streaming import annotations as stream


def test_robust_line_survives_outliers():
    rng = np.random.default_rng(0)
    x = rng.uniform(1, 10, 60)
    y = 2.5 * x + 1
    y[:12] += rng.uniform(20, 40, 12)
    a, b = numeric.robust_affine(x, y)
    assert abs(a - 2.5) < 0.5 and abs(b - 1) < 5
    a, _ = numeric.robust_affine(x, -2 * x + 5)
    assert a == pytest.approx(-2)


@pytest.mark.parametrize("robust", [False, True])
def test_background_alignment(spark, robust):
    rng = np.random.default_rng(1)
    depth = rng.uniform(2, 9, (40, 40))
    mask = np.zeros((40, 40), bool)
    mask[10:20, 10:20] = True
    rows = [(1, "g", 40, 40, (2 * depth - 4).ravel().tolist(), mask.ravel().tolist(), 20.0), (2, "g", 40, 40, depth.ravel().tolist(), mask.ravel().tolist(), 4.0),
            (3, "h", 40, 40, depth.ravel().tolist(), [True] * 1600, 9.0), (4, "h", 40, 40, depth.ravel().tolist(), [True] * 1600, 5.0)]
    frames = spark.createDataFrame(rows, "frame_id long, grp string, h int, w int, depth array<double>, mask array<boolean>, distance_gt double")
    fit = align.align_ransac(frames, seeded=True) if robust else align.align_least_squares(frames)
    got = {r["frame_id"]: (r["a"], r["b"]) for r in fit.collect()}
    assert got[2] == pytest.approx((2, -4)) and got[1] == (1, 0) and got[4] == (1, 0)
    values = {r["frame_id"]: r["value"] for r in align.aligned_subject(frames, fit).collect()}
    assert values[2] == pytest.approx(np.median(2 * depth[mask] - 4))


def test_shape_mismatch_is_an_error(spark):
    rows = [(1, "g", 2, 2, [1.0] * 4, [False] * 4, 20.0), (2, "g", 1, 2, [1.0] * 2, [False] * 2, 4.0)]
    frames = spark.createDataFrame(rows, "frame_id long, grp string, h int, w int, depth array<double>, mask array<boolean>, distance_gt double")
    with pytest.raises(Exception, match="shape"):
        align.align_least_squares(frames).collect()


def test_reference_pick(spark):
    df = spark.createDataFrame([(1, "g", 4.0), (2, "g", 20.0), (3, "g", 10.0), (4, "g", 20.0)], "frame_id long, grp string, distance_gt double")
    assert align.pick_reference(df).first()["reference"] == 2
    assert align.pick_reference(df.where("frame_id < 4"), "median").first()["reference"] == 3
    with pytest.raises(ValueError):
        align.pick_reference(df, "nearest")


def test_mask_codec_round_trip(spark):
    rng = np.random.default_rng(2)
    for shape in ((30, 40), (1, 1), (5, 1)):
        for fill in (0.0, 0.3, 1.0):
            mask = rng.uniform(size=shape) < fill
            assert np.array_equal(maps.decode_mask(maps.encode_mask(mask)), mask)
    assert maps.pack_runs([6, 1, 40, 4, 5, 4, 5, 4, 21]) == maps.pack_runs(maps.unpack_runs(maps.pack_runs([6, 1, 40, 4, 5, 4, 5, 4, 21])))
    mask = rng.uniform(size=(8, 8)) < 0.4
    df = spark.createDataFrame([(mask.ravel().tolist(),)], "mask array<boolean>")
    assert df.select(maps.mask_runs(F.col("mask"), 8, 8).alias("r")).first()["r"] == maps.runs_of(mask)


def test_mask_reductions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 100.0], [True] * 4), ([1.0, float("nan"), 3.0, 4.0], [False, True, False, False])], "d array<double>, m array<boolean>")
    got = df.select(maps.median_of(maps.in_mask(F.col("d"), F.col("m"))).alias("md"), maps.mean_of(maps.in_mask(F.col("d"), F.col("m"))).alias("mn")).collect()
    assert got[0]["md"] == 2.5 and got[1]["md"] is None and got[1]["mn"] is None
    u = spark.createDataFrame([([[True, False], [False, False]],)], "m array<array<boolean>>").select(maps.union_mask(F.col("m")).alias("u")).first()["u"]
    assert u == [True, False]


def test_instances_are_ordered_by_center(spark):
    df = spark.createDataFrame([([(5, 3), (1, 0), (2, 7), (2, 9)],)], "i array<struct<center_x int, area int>>")
    got = df.select(maps.number_instances(F.col("i")).alias("n")).first()["n"]
    assert [(x["instance_idx"], x["instance"]["area"]) for x in got] == [(0, 7), (1, 9), (2, 3)]


def test_resizing():
    d = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert maps.resize_cubic(d, (3, 4)) is d
    flat = maps.resize_cubic(np.full((3, 4), 7, np.float32), (6, 5))
    assert flat.shape == (6, 5) and np.allclose(flat, 7)


def test_formats(spark):
    df = spark.createDataFrame([(25.0, "30000/1001", "a/b_c.d/x.AVI"), (23.976, "0/0", "x.mp4"), (1e-7, "N/A", ""), (1234567.0, "", "q"), (0.0, "25", "r")], "x double, r string, p string")
    got = df.select(scalar.general_format(F.col("x")).alias("g"), scalar.parse_rate(F.col("r")).alias("r"), scalar.flat_name(F.col("p")).alias("f")).collect()
    assert [r["g"] for r in got] == [f"{x:g}" for x in (25.0, 23.976, 1e-7, 1234567.0, 0.0)]
    assert [r["r"] for r in got] == [pytest.approx(30000 / 1001), None, None, None, 25.0] and got[0]["f"] == "a_b_c.d_x"
    assert scalar.model_input_size(1280, 720) == (672, 378) or scalar.model_input_size(1280, 720)[0] % 14 == 0


def test_qc_flags_and_repair(spark):
    fps = spark.createDataFrame([("a_1", 25.0, 10.0), ("a_2", 24.0, None)], "video_name string, fps double, duration_s double")
    rows = [("a_1", 25, 1.0, 5.0), ("a_1", 30, 1.0, 5.0), ("a_1", 300, 12.0, 500.0), ("b_9", 3, 1.0, 0.0), ("a_2", 10**6, 99.0, 5.0)]
    df = spark.createDataFrame(rows, "video_name string, frame_idx int, frame_timestamp double, distance double")
    got = {(r["video_name"], r["frame_idx"], r["reason"]): r["detail"] for r in qc.collect_flags(df, fps).collect()}
    assert set(got) == {("a_1", 30, "FRAME_IDX_FPS_MISMATCH"), ("a_1", 300, "TIMESTAMP_PAST_END"), ("a_1", 300, "ABSURD_DISTANCE"), ("b_9", 3, "VIDEO_NOT_ON_DISK"), ("b_9", 3, "ZERO_DISTANCE"), ("a_2", 10**6, "FRAME_IDX_FPS_MISMATCH")}
    assert got["a_1", 30, "FRAME_IDX_FPS_MISMATCH"] == "expected frame_idx 25 at fps 25" and got["a_1", 300, "TIMESTAMP_PAST_END"] == "video duration 10.0s"
    clean = sorted((r["video_name"], r["frame_idx"]) for r in qc.apply_fixes(df, fps).collect())
    assert clean == [("a_1", 25), ("a_1", 25), ("a_2", 2376)]
    assert qc.collect_flags(df.where("false"), fps).count() == 0
    with pytest.raises(Exception, match="repeated video"):
        qc.collect_flags(df, fps.union(fps)).collect()


def test_stream_flags(spark, tmp_path):
    fps = spark.createDataFrame([("a_1", 25.0, 10.0)], "video_name string, fps double, duration_s double")
    df = spark.createDataFrame([("a_1", 30, 1.0, 500.0)], "video_name string, frame_idx int, frame_timestamp double, distance double")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream.flag_stream(source, fps).writeStream.format("memory").queryName("flags_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["reason"] for r in spark.table("flags_out").collect()} == {"FRAME_IDX_FPS_MISMATCH", "ABSURD_DISTANCE"}


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("video_name,frame_idx,frame_timestamp,distance\nv,3,0.1,5\nw,4,0.2,6\nx,5,0.3,7\n")
    assert [r["video_name"] for r in files.read_annotations(spark, str(tmp_path / "a.csv"), 2).orderBy("ord").collect()] == ["v", "w"]
    (tmp_path / "r.csv").write_text("video_name,frame_idx,status,depth_mask_mean,instance_idx\nv,3,processed,None,\nw,4,processed,2.5,1\n")
    got = files.read_results(spark, str(tmp_path / "r.csv")).orderBy("ord").collect()
    assert got[0]["depth_mask_mean"] is None and got[0]["instance_idx"] is None and got[1]["depth_mask_mean"] == 2.5
    depth = np.arange(6, dtype=np.float16).reshape(2, 3)
    maps_in = spark.createDataFrame([("v_frame000003_orig.npy", 2, 3, depth.ravel().tolist())], "name string, h int, w int, depth array<double>")
    assert files.write_npy(maps_in, str(tmp_path / "npy"), "float16").count() == 1
    back = files.read_npy(spark, str(tmp_path / "npy")).first()
    assert (back["h"], back["w"]) == (2, 3) and back["depth"] == depth.ravel().tolist()
    mask = np.array([[True, False], [True, True]])
    import json

    (tmp_path / "m.json").write_text(json.dumps([{"instance_idx": 0, "center_xy": [0, 1], "area_px": 3, "rle": maps.encode_mask(mask)}]))
    inst = files.read_masks(spark, str(tmp_path / "m.json")).first()["instances"][0]
    assert np.array_equal(maps.decode_mask({"size": inst["rle"]["size"], "counts": inst["rle"]["counts"]}), mask)


def _workbook(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        cells = "".join("<row>" + "".join(f'<c r="{c}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in zip("AB", row, strict=True) if v is not None) + "</row>" for i, row in enumerate(rows, 1))
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_video_list(spark, tmp_path):
    (tmp_path / "l.xlsx").write_bytes(_workbook([("ori", "anno"), ("s/c/a.avi", "v"), ("s/c/b.avi", None), ("s/d/a.avi", "v")]))
    got = files.read_video_list(spark, str(tmp_path / "l.xlsx"), "/data")
    assert sorted((r["anno"], r["ori"]) for r in got.collect()) == [("v", "/data/s/c/a.avi"), ("v", "/data/s/d/a.avi")]


def test_probe_and_frames(spark):
    def prober(path):
        if path == "bad":
            raise OSError
        return {"fps": "30000/1001", "avg_fps": "25/1", "nb_frames": "7", "duration_s": "1.5"}

    got = {r["path"]: r for r in files.probe_videos(spark.createDataFrame([("ok",), ("bad",)], "path string"), prober).collect()}
    assert got["ok"]["vfr"] and got["ok"]["duration_s"] == 1.5 and got["bad"]["fps"] is None and not got["bad"]["vfr"]

    def decode(path):
        if path == "bad":
            raise OSError("no such video")
        return (np.full((2, 2), i) for i in range(5))

    assert [(i, None if f is None else int(f[0, 0])) for i, f in files.frames_at(decode, "x", [4, 1, 1, 9])] == [(1, 1), (4, 4), (9, None)]
    rows = files.read_frames(spark.createDataFrame([("x", 1), ("x", 9), ("bad", 2)], "path string, frame_idx int"), decode).collect()
    assert {(r["path"], r["frame_idx"]): r["status"] for r in rows} == {("x", 1): None, ("x", 9): "frame_decode_error", ("bad", 2): "video_error: no such video"}


def test_backend_errors_stay_with_the_video(spark):
    frames = spark.createDataFrame([("v", 1, 2, 2, [1.0, 2.0, 3.0, 4.0]), ("w", 1, 2, 2, [1.0, 2.0, 3.0, 9.0])], "video_name string, frame_idx int, h int, w int, pixels array<double>")

    def backend(stack):
        if stack.max() > 5:
            raise RuntimeError("out of memory")
        return evaluate.synthetic_backend(stack)

    got = {r["video_name"]: r for r in evaluate.estimate_depth(frames, backend).collect()}
    assert got["v"]["status"] == "processed" and got["w"]["status"] == "depth_error: out of memory" and got["w"]["depth"] is None


def test_export_pairs(spark):
    paths = spark.createDataFrame([("/m/v_frame000003_calib.npy",), ("/m/v_frame000004_calib.npy",), ("/m/x.npy",)], "path string")
    frames = spark.createDataFrame([("v", 3), ("v", 3), ("v", 5)], "video_name string, frame_idx int")
    got = export.export_pairs(export.list_calibrated(paths), frames).collect()
    assert [(r["video_name"], r["frame_idx"]) for r in got] == [("v", 3)]


def test_whole_evaluation(spark):
    a = spark.createDataFrame([("v", 1, 5.0), ("v", 1, 6.0), ("v", 9, 7.0), ("w", 0, 1.0), ("bad", 2, 3.0), ("err", 0, 2.0)], "video_name string, frame_idx int, distance_gt double")
    videos = spark.createDataFrame([("/x/v", "v"), ("/x/bad", "bad"), ("/x/err", "err")], "ori string, anno string")

    def decode(path):
        if path.endswith("bad"):
            raise OSError("broken")
        return (np.array([[1.0, 5.0], [1.0 + i, 9.0]]) if not path.endswith("err") else np.full((2, 2), 100.0) for i in range(3))

    def backend(stack):
        if stack.max() > 50:
            raise RuntimeError("too bright")
        return evaluate.synthetic_backend(stack)

    rows = evaluate.evaluate_annotations(a, videos, decode, backend).collect()
    got = sorted((r["video_name"], r["frame_idx"], r["distance_gt"], r["status"]) for r in rows)
    assert got == [("bad", 2, 3.0, "video_error: broken"), ("err", 0, 2.0, "depth_error: too bright"), ("v", 1, 5.0, "processed"), ("v", 1, 6.0, "processed"), ("v", 9, 7.0, "frame_decode_error"), ("w", 0, 1.0, "video_missing")]
    assert all(r["mask_area_px"] == 2 and r["depth_mask_mean"] > 0 for r in rows if r["status"] == "processed")
    counts = {r["status"]: r["n"] for r in evaluate.status_counts(spark.createDataFrame(rows)).collect()}
    assert counts["depth_error"] == 1 and counts["processed"] == 2
    assert evaluate.summary_line(evaluate.error_metrics(spark.createDataFrame(rows)).first().asDict()).startswith("n=2 ")


def test_panels(spark, tmp_path):
    import struct

    from depthcal.operators import panels

    d = np.array([[1.0, np.nan], [np.inf, 3.0]])
    assert panels.colour_index(d).tolist() == [[0, 0], [255, 255]] and not panels.colourise(np.full((2, 2), np.nan)).any()
    assert panels.outline(np.ones((3, 3), bool)).sum() == 8 and panels.colour_bar(5).shape == (5, 16, 3)
    df = spark.createDataFrame([("a.png", 2, 2, d.ravel().tolist())], "name string, h int, w int, d array<double>")
    made = df.select("name", panels.pair_png("h", "w", "d", "d").alias("png"))
    assert [r["name"] for r in panels.write_panels(made, str(tmp_path)).collect()] == ["a.png"]
    data = (tmp_path / "a.png").read_bytes()
    assert struct.unpack(">II", data[16:24]) == (20, 2)


def test_rate_rows(spark):
    probed = spark.createDataFrame([("/r/s/c/a.AVI", 29.97002997, 25.0, 10.123456789, "7", True), ("/r/b.mp4", None, None, None, None, False)],
                                   "path string, fps double, avg_fps double, duration_s double, nb_frames string, vfr boolean")
    got = {r["video_name"]: r for r in files.fps_rows(probed, "/r").collect()}
    assert got["s_c_a"]["fps"] == "29.97" and got["s_c_a"]["duration_s"] == "10.1235" and got["s_c_a"]["path"] == "s/c/a.AVI" and got["b"]["fps"] is None


def test_sweep_over_alignments_and_levels(spark):
    from depthcal.plans import sweep

    rng = np.random.default_rng(0)
    ground = rng.uniform(5, 20, 21)
    rows, maps = [], []
    for v in ("a", "b"):
        for f in range(6):
            gt = 2.0 + f + (v == "b") / 2
            s, c = rng.uniform(0.5, 2), rng.uniform(0, 1)
            depth = (np.concatenate([np.full(4, 2 * gt + 1), ground]) + c) * s
            rows.append((v, f, 0, "processed", float(depth[0]), float(depth[0]), gt, 0.5, len(rows)))
            if (v, f) != ("b", 2):
                maps.append((v, f, 0, depth.tolist(), [True] * 4 + [False] * 21))
    results = spark.createDataFrame(rows, "video_name string, frame_idx int, instance_idx int, status string, depth_mask_mean double, depth_centroid double, distance_gt double, center_y_norm double, ord int")
    maps = spark.createDataFrame(maps, "video_name string, frame_idx int, instance_idx int, depth array<double>, mask array<boolean>")
    videos = spark.createDataFrame([("/cam/x.mp4", "a"), ("/cam/y.mp4", "b")], "ori string, anno string")
    own = results.where("video_name = 'a'")
    options = {"anchors": ("mask_mean",), "methods": ("linear",), "aligns": ("none", "ransac"), "ref_frame_methods": ("furthest", "median")}
    got = sweep.sweep(own, maps=maps, **options).orderBy("sweep_ord").collect()
    assert [(r["align"], r["ref_frame_method"], r["calib_level"], r["robust"]) for r in got] == [(a, m, "clip", b) for a, m in (("none", ""), ("ransac", "furthest"), ("ransac", "median")) for b in (False, True)]
    assert all((r["mean_loo_mae_cal"] < 1e-3) == (r["align"] == "ransac") for r in got)
    levels = {level: sweep.sweep(results, maps=maps, videos=videos, calib_level=level, **options).collect() for level in ("clip", "cam")}
    assert all(r["n_groups_total"] == (1 if level == "cam" else 2) and r["calib_level"] == level for level, rs in levels.items() for r in rs)
    cam = {(r["align"], r["ref_frame_method"]): r["mean_loo_mae_cal"] for r in levels["cam"] if r["robust"] is False}
    assert cam["ransac", "furthest"] < cam["none", ""]  # one point of twelve has no map and keeps its prediction
    assert len(sweep.grid(aligns=("none", "ransac"), ref_frame_methods=("furthest", "median"))) == 60
    with pytest.raises(ValueError):
        sweep.sweep(own, **options)
