import numpy as np
import pytest
from pyspark.sql import functions as F

from depthcal.functions import numeric
from depthcal.operators import calibrators, loo, points


def frame(spark, groups):
    rows = [(g, float(x), float(y), float(v)) for g, pts in groups.items() for x, y, v in pts]
    return spark.createDataFrame(rows, "group_key string, pred double, gt_m double, v double")


def curve(f, xs):
    return [(x, f(x), 0.5) for x in xs]


def one(df):
    return df.first().asDict()


def test_recovers_parameters(spark):
    p = frame(spark, {"g": curve(lambda d: 2 * d + 1, range(1, 6))})
    r = one(calibrators.fit_linear(p))
    assert r["a"] == pytest.approx(2) and r["b"] == pytest.approx(1)
    assert one(calibrators.fit_scale(frame(spark, {"g": curve(lambda d: 3 * d, (2, 4, 6, 8))})))["s"] == pytest.approx(3)
    r = one(calibrators.fit_disparity(frame(spark, {"g": curve(lambda d: 1 / (1.5 / d + 0.2), (2, 3, 5, 8, 13))})))
    assert r["a"] == pytest.approx(1.5) and r["b"] == pytest.approx(0.2)
    c = one(calibrators.fit_poly(frame(spark, {"g": curve(lambda d: 0.5 * d * d - d + 2, range(1, 7))})))["coeffs"]
    assert c == pytest.approx([0.5, -1, 2])


def test_surface_is_reproduced(spark):
    rng = np.random.default_rng(0)
    pts = [(d, 1 + 0.5 * d + 2 * v, v) for d, v in zip(rng.uniform(1, 9, 10), rng.uniform(0, 1, 10), strict=True)]
    c = one(calibrators.fit_poly2d(frame(spark, {"g": pts})))["coeffs"]
    assert numeric.predict("poly2d", {"coeffs": c}, np.array([4.0]), np.array([0.25]))[0] == pytest.approx(1 + 2 + 0.5)


def test_piecewise_joins_and_falls_back(spark):
    f = lambda d: 2 * d + 1 if d <= 10 else 21 + 5 * (d - 10)
    r = one(calibrators.fit_piecewise(frame(spark, {"g": curve(f, (2, 4, 6, 8, 10, 12, 14, 16, 18))})))
    assert (r["a1"], r["b1"], r["a2"], r["k"]) == pytest.approx((2, 1, 5, 10))
    r = one(calibrators.fit_piecewise(frame(spark, {"g": curve(lambda d: 2 * d, (1, 2, 3))})))
    assert r["k"] == float("inf") and r["a1"] == pytest.approx(2)


@pytest.mark.parametrize(("method", "robust"), [("scale", False), ("linear", False), ("linear", True), ("disparity", False), ("piecewise", False), ("scale", True)])
def test_aggregates_match_numpy(spark, method, robust):
    rng = np.random.default_rng(3)
    groups = {f"g{k}": [(x, 0.7 * x + rng.normal(), rng.uniform()) for x in np.round(rng.uniform(1, 9, 1 + k), 1)] for k in range(9)}
    groups["flat"] = [(2, 3, 0), (2, 5, 0), (2, 4, 0)]
    rows = {r["group_key"]: r.asDict() for r in calibrators.fit(frame(spark, groups), method, robust).collect()}
    for g, pts in groups.items():
        x, y, v = map(np.array, zip(*pts, strict=True))
        if not numeric.usable(x, y).any():
            continue
        for name, value in numeric.fit(method, x, y, v, robust=robust).items():
            assert rows[g][name] == pytest.approx(value, rel=1e-8, abs=1e-9), (g, name)


@pytest.mark.parametrize("method", ["scale", "linear", "disparity"])
def test_closed_leave_one_out_matches_refits(spark, method):
    rng = np.random.default_rng(5)
    groups = {f"g{k}": [(x, abs(0.7 * x + rng.normal()) + 0.1, 0.0) for x in np.round(rng.uniform(1, 4, 1 + k), 1)] for k in range(8)}
    groups |= {"two": [(1, 2, 0), (1, 3, 0), (4, 2, 0)], "flat": [(2, 3, 0), (2, 5, 0), (2, 4, 0)], "far": [(1, 2, 0), (1.0000001, 3, 0), (1.0000002, 4, 0), (900, 5, 0)]}
    got: dict = {}
    for r in loo.loo(frame(spark, groups), method).collect():
        got.setdefault(r["group_key"], []).append((r["gt_m"], r["err_cal"]))
    for g, pts in groups.items():
        x, y, _ = map(np.array, zip(*pts, strict=True))
        gt, _, refit = numeric.leave_one_out(method, x, y)
        if refit is None:
            assert all(c is None for _, c in got[g])
        else:
            assert [c for _, c in sorted(got[g])] == pytest.approx([c for _, c in sorted(zip(gt, refit, strict=True))], rel=1e-6, abs=1e-8), g


def test_small_groups_and_summary(spark):
    p = frame(spark, {"a": curve(lambda d: 2 * d + 1, range(1, 7)), "b": [(4, 8, 0)]})
    scores = {r["group_key"]: r for r in loo.group_scores(loo.loo_linear(p)).collect()}
    assert scores["a"]["loo_mae_cal"] == pytest.approx(0, abs=1e-9) and scores["b"]["loo_mae_cal"] is None and scores["b"]["loo_mae_uncal"] == 4
    s = one(loo.summary(loo.group_scores(loo.loo_linear(p))))
    assert s["n_groups_total"] == 2 and s["n_groups_scored"] == 1 and s["pct_groups_improved"] == 100
    assert one(calibrators.fit_poly(frame(spark, {"b": [(4, 8, 0)]})))["coeffs"] == [2.0, 0.0]


def test_errors():
    with pytest.raises(ValueError):
        numeric.fit("spline", [1], [1])
    with pytest.raises(ValueError):
        numeric.fit("linear", [], [])
    with pytest.raises(ValueError):
        numeric.fit("poly2d", [1, 2], [1, 2])


def test_maps_keep_invalid_pixels():
    d = np.array([[2, 0, -1], [np.nan, np.inf, 4]])
    out = numeric.apply_to_map("linear", {"a": 2, "b": 1}, d)
    assert np.array_equal(out, np.array([[5, 0, -1], [np.nan, np.inf, 9]], np.float32), equal_nan=True)
    fit = numeric.fit("linear", [3, 4, 5], [5, 4, 3])
    out = numeric.apply_to_map("linear", fit, np.array([[4.0, 100.0]]))
    assert np.isfinite(out[0, 0]) and np.isnan(out[0, 1])


def test_points_first_row_wins_and_exclusions_only_remove(spark):
    rows = [("v", 1, 0, "processed", 3.0, 1.0, 0.1, 2), ("v", 1, 0, "processed", 9.0, 9.0, 0.1, 5), ("v", 1, None, "processed", 4.0, 1.0, 0.1, 3), ("v", 2, 0, "empty_mask", None, 1.0, 0.1, 1), ("v", 3, 0, "processed", 5.0, 1.0, 0.1, 4)]
    df = spark.createDataFrame(rows, "video_name string, frame_idx int, instance_idx int, status string, depth_mask_mean double, distance_gt double, center_y_norm double, ord int")
    got = {(r["frame_idx"], r["instance_idx"]): r["pred"] for r in points.load_points(df).collect()}
    assert got == {(1, 0): 3.0, (1, None): 4.0, (3, 0): 5.0}
    less = points.load_points(df, exclusions=spark.createDataFrame([("v", 3)], "video_name string, frame_idx int"))
    assert {(r["frame_idx"], r["instance_idx"]) for r in less.collect()} == {(1, 0), (1, None)}


def test_unknown_camera_is_an_error(spark):
    p = spark.createDataFrame([("v", 1, 0, 1.0, 1.0, 0.0)], "video_name string, frame_idx int, instance_idx int, pred double, gt_m double, v double")
    known = spark.createDataFrame([("v", "a/b/x.avi", 0), ("v", "a/c/x.avi", 1)], "anno string, ori string, row long")
    assert points.by_camera(p, known).first()["group_key"] == "a/c"
    with pytest.raises(Exception, match="no path for video"):
        points.by_camera(p, known.where("anno = 'w'")).collect()


def test_batched_refits_equal_single_ones():
    rng = np.random.default_rng(5)
    for method, options in (("scale", {}), ("scale", {"robust": True}), ("linear", {}), ("linear", {"robust": True}), ("disparity", {}), ("poly", {}), ("poly", {"degree": 3}), ("poly2d", {}), ("piecewise", {})):
        for n in (2, 3, 5, 6, 9):
            if n < numeric.MIN_POINTS[method] + 1:
                continue
            x, y, v = rng.uniform(1, 9, (4, n)).round(1), rng.uniform(1, 9, (4, n)), rng.uniform(0, 1, (4, n))
            got = numeric.leave_one_out_rows(method, x, y, v if method == "poly2d" else None, **options)
            for g in range(4):
                for i in range(n):
                    rest = np.arange(n) != i
                    p = numeric.fit(method, x[g][rest], y[g][rest], v[g][rest], **options)
                    assert got[g, i] == pytest.approx(abs(numeric.predict(method, p, x[g, i:i + 1], v[g, i:i + 1])[0] - y[g, i]), rel=1e-6, abs=1e-6), (method, n)


def test_piecewise_equals_a_search_over_all_joints():
    rng = np.random.default_rng(6)
    for n in (4, 5, 8, 30):
        x, y = rng.uniform(1, 9, n).round(1), rng.uniform(1, 9, n)
        best = None
        for k in sorted(set(x))[1:-1]:
            low = x <= k
            a, b = numeric.line(x[low], y[low])
            rise = ((x - k) * (y - a * k - b))[~low].sum() / ((x - k)[~low] ** 2).sum()
            error = ((np.where(low, a * x + b, a * k + b + rise * (x - k)) - y) ** 2).sum()
            best = min(best or (error, k, a, rise), (error, k, a, rise))
        p = numeric.fit("piecewise", x, y)
        assert (p["k"], p["a1"], p["a2"]) == pytest.approx(best[1:])


def test_input_size_and_rates(spark):
    from depthcal.functions import scalar

    assert scalar.model_input_size(720, 404) == (672, 378) and scalar.model_input_size(1, 1)[0] <= 504
    for w, h in ((400, 4000), (3000, 70), (640, 480), (1920, 1080)):
        a, b = scalar.model_input_size(w, h)
        assert a % 14 == b % 14 == 0 and a * b <= 255_000
    texts = ["30000/1001", "25", "2.5/1", "0/0", "N/A", "", " 24/1 ", "1e1", "nan", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(scalar.parse_rate(F.col("t"))).collect()]
    assert got == [30000 / 1001, 25.0, None, None, None, None, 24.0, 10.0, None, None]


def test_piecewise_joint_with_close_predictions(spark):
    # Two predictions so close that sums of squares about the group's mean lose their distance.
    groups = {"a": ((16.7, 16.7000001, 27.99, 31.68, 42.79, 43.37), (49, 37, 3, 8, 27, 41), (-3.54296, 102.16741, 2.04196, 27.99)),
              "b": ((26.83, 26.83000001, 37.62, 48.27, 49.13), (14, 36, 8, 16, 48), (-0.52747, 36.90223, 42.51037, 48.27)),
              "c": ((10.6, 10.6000001, 18.29, 23.07, 28.65, 43.11, 48.42), (48, 36, 35, 10, 46, 20, 47), (-0.55519, 44.92895, 4.89745, 43.11))}
    rows = {r["group_key"]: r for r in calibrators.fit_piecewise(frame(spark, {g: [(x, y, 0.5) for x, y in zip(*p[:2], strict=True)] for g, p in groups.items()})).collect()}
    for g, (x, y, want) in groups.items():  # of exact arithmetic over all joints
        assert [rows[g][c] for c in ("a1", "b1", "a2", "k")] == pytest.approx(want, rel=1e-5)
        assert [float(c[0]) for c in numeric.segments(np.array([x]), np.array([y], float))] == pytest.approx(want, rel=1e-5)
