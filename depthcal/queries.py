"""Queries over the fixtures and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalar
from .operators import align, calibrators, evaluate, export, loo, maps, points, qc
from .plans import calibrate as cal
from .plans import fixtures as fx
from .plans import sweep as sw

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a query, and its SQL behind the named common table expressions."""
    def add(function):
        QUERIES[name] = function
        if sql:
            views = {**fx.CTES, **_CTES}
            parts = ", ".join(f"{c} AS ({views[c]})" for c in ctes)
            SQL[name] = (f"WITH {parts} " if parts else "") + sql
        return function

    return add


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_POINTS = """SELECT video_name, frame_idx, instance_idx, {pred} AS pred, distance_gt AS gt_m, center_y_norm AS v, video_name AS group_key
  FROM (SELECT *, row_number() OVER (PARTITION BY video_name, frame_idx, instance_idx ORDER BY row_id) AS rn FROM {source}) WHERE rn = 1"""
_USABLE = "WHERE pred > 0 AND gt_m > 0 AND NOT isnan(pred) AND NOT isnan(gt_m)"
_PROCESSED = "(SELECT * FROM f_results WHERE status = 'processed')"


def _line(x: str, y: str, a: str = "a", b: str = "b") -> str:
    return (f"CASE WHEN count(*) = 1 THEN min({y}) / min({x}) WHEN min({x}) = max({x}) THEN avg({y}) / (2 * min({x})) ELSE regr_slope({y}, {x}) END AS {a}, "
            f"CASE WHEN count(*) = 1 THEN 0e0 WHEN min({x}) = max({x}) THEN avg({y}) / 2 ELSE regr_intercept({y}, {x}) END AS {b}")


def _loo_line(x: str, y: str, value: str, source: str = "q") -> str:
    """Residuals of lines refitted by a self-join; ``value`` is the prediction from a, b and pred."""
    return f"""SELECT p.group_key, p.gt_m, abs(p.pred - p.gt_m) AS err_uncal, CASE WHEN p.n >= 3 THEN abs({value} - p.gt_m) END AS err_cal
      FROM (SELECT *, count(*) OVER (PARTITION BY group_key) AS n FROM {source}) p
      LEFT JOIN (SELECT i.id, {_line(f'({x})', f'({y})')} FROM {source} i JOIN {source} o ON i.group_key = o.group_key AND i.id <> o.id GROUP BY i.id) f ON p.id = f.id"""


_THEIL = """SELECT s.id, a, median(o.gt_m - a * o.pred) AS b FROM
      (SELECT i.id, any_value(i.group_key) AS group_key, coalesce(median((r.gt_m - l.gt_m) / (r.pred - l.pred)), 0) AS a FROM {q} i JOIN {q} l ON l.group_key = i.group_key AND l.id <> i.id
        LEFT JOIN {q} r ON r.group_key = i.group_key AND r.id <> i.id AND l.pred < r.pred GROUP BY 1) s
      JOIN {q} o ON o.group_key = s.group_key AND o.id <> s.id GROUP BY 1, 2"""


def _residual_ctes(q: str, end: str) -> dict[str, str]:
    """Leave-one-out residuals over the numbered points ``q`` of the methods that SQL refits by self-joins."""
    head = f"SELECT p.group_key, p.gt_m, abs(p.pred - p.gt_m) AS err_uncal, CASE WHEN n >= {{least}} THEN abs({{value}} - p.gt_m) END AS err_cal FROM (SELECT *, count(*) OVER (PARTITION BY group_key) AS n FROM {q}) p"
    scale = f"LEFT JOIN (SELECT i.id, {{s}} AS s FROM {q} i JOIN {q} o ON i.group_key = o.group_key AND i.id <> o.id GROUP BY i.id) f ON p.id = f.id"
    return {
        f"res_linear{end}": _loo_line("o.pred", "o.gt_m", "(a * p.pred + b)", q),
        f"res_disparity{end}": _loo_line("1 / o.pred", "1 / o.gt_m", "(1 / (a / p.pred + b))", q),
        f"res_scale{end}": f"{head.format(least=2, value='s * p.pred')} {scale.format(s='sum(o.pred * o.gt_m) / sum(o.pred * o.pred)')}",
        f"res_scale_robust{end}": f"{head.format(least=2, value='s * p.pred')} {scale.format(s='median(o.gt_m / o.pred)')}",
        f"res_theil_sen{end}": f"{head.format(least=3, value='(a * p.pred + b)')} LEFT JOIN ({_THEIL.format(q=q)}) f ON p.id = f.id",
    }


_CTES = {
    "points": _POINTS.format(pred="depth_mask_mean", source=_PROCESSED),
    "points_centroid": _POINTS.format(pred="depth_centroid", source=_PROCESSED),
    "points_kept": _POINTS.format(pred="depth_mask_mean", source="(SELECT r.* FROM f_results r ANTI JOIN f_exclusions e ON r.video_name = e.video_name AND r.frame_idx = e.frame_idx WHERE status = 'processed')"),
    "p": f"SELECT * FROM points {_USABLE}",
    "q": f"SELECT *, row_number() OVER (ORDER BY video_name, frame_idx, instance_idx) AS id FROM points {_USABLE}",
    "q_centroid": f"SELECT *, row_number() OVER (ORDER BY video_name, frame_idx, instance_idx) AS id FROM points_centroid {_USABLE}",
    **_residual_ctes("q", ""), **_residual_ctes("q_centroid", "_centroid"),
    # Piecewise refits: every point left out (id), every inner distinct prediction of the others tried as the joint.
    "others": "SELECT i.id, i.group_key, o.pred, o.gt_m FROM q i JOIN q o ON i.group_key = o.group_key AND i.id <> o.id WHERE i.group_key IN (SELECT group_key FROM q GROUP BY 1 HAVING count(*) >= 5)",
    "o_ends": f"SELECT id, min(pred) AS lo, max(pred) AS hi, {_line('pred', 'gt_m', 'la', 'lb')} FROM others GROUP BY 1",
    "o_tried": "SELECT k.id, k.k, o.pred, o.gt_m FROM (SELECT DISTINCT o.id, pred AS k FROM others o JOIN o_ends e ON o.id = e.id WHERE pred > lo AND pred < hi) k JOIN others o ON o.id = k.id",
    "o_low": "SELECT id, k, regr_slope(gt_m, pred) AS a1, regr_intercept(gt_m, pred) AS b1 FROM o_tried WHERE pred <= k GROUP BY 1, 2",
    "o_high": "SELECT t.id, t.k, sum((pred - t.k) * (gt_m - (a1 * t.k + b1))) / sum((pred - t.k) * (pred - t.k)) AS a2 FROM o_tried t JOIN o_low l ON l.id = t.id AND l.k = t.k WHERE pred > t.k GROUP BY 1, 2",
    "o_best": """SELECT id, min_by(struct_pack(a1 := a1, b1 := b1, a2 := a2, k := k), struct_pack(sse := sse, k := k)) AS m FROM (SELECT t.id, t.k, any_value(a1) AS a1, any_value(b1) AS b1, any_value(a2) AS a2,
      sum(CASE WHEN pred > t.k THEN (a1 * t.k + b1 + a2 * (pred - t.k) - gt_m) ** 2 ELSE (a1 * pred + b1 - gt_m) ** 2 END) AS sse
      FROM o_tried t JOIN o_low l ON l.id = t.id AND l.k = t.k JOIN o_high h ON h.id = t.id AND h.k = t.k GROUP BY 1, 2) GROUP BY 1""",
    "res_piecewise": """SELECT p.group_key, p.gt_m, abs(p.pred - p.gt_m) AS err_uncal, CASE WHEN e.id IS NULL THEN NULL ELSE abs(CASE WHEN m IS NULL THEN la * p.pred + lb
      WHEN p.pred <= m.k THEN m.a1 * p.pred + m.b1 ELSE m.a1 * m.k + m.b1 + m.a2 * (p.pred - m.k) END - p.gt_m) END AS err_cal FROM q p LEFT JOIN o_ends e ON e.id = p.id LEFT JOIN o_best b ON b.id = p.id""",
    # Alignment on files: references by distance, the gate on the number of points, and what falls back.
    "c_refs": "SELECT grp, frame_id AS reference FROM (SELECT grp, frame_id, there, row_number() OVER (PARTITION BY grp ORDER BY distance_gt DESC, frame_id) AS rn, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT DISTINCT grp, frame_id, distance_gt, there FROM f_filed)) WHERE rn = 1 AND there AND n >= 45",
    "c_bg": """SELECT f.frame_id, f.depth AS x, r.depth AS y FROM f_filed f JOIN c_refs c ON c.grp = f.grp JOIN f_filed r ON r.frame_id = reference AND r.pos = f.pos
      WHERE f.there AND NOT f.subject AND NOT r.subject AND NOT isnan(f.depth) AND NOT isnan(r.depth)""",
    "c_line": f"SELECT frame_id, count(*) AS n, {_line('x', 'y')} FROM c_bg GROUP BY 1",
    "c_value": """SELECT f.frame_id, median(CASE WHEN f.frame_id = reference OR coalesce(n, 0) < 8 THEN depth ELSE a * depth + b END) AS value FROM f_filed f JOIN c_refs c ON c.grp = f.grp
      LEFT JOIN c_line l ON l.frame_id = f.frame_id WHERE there AND subject AND NOT isnan(depth) GROUP BY 1""",
    "c_q": f"""SELECT *, frame_id AS id FROM (SELECT concat('cam', cast(p.grp AS string)) AS group_key, p.frame_id, coalesce(value, 5e0 + (p.frame_id * 13 % 17) / 4e0) AS pred, distance_gt AS gt_m, reference
      FROM (SELECT DISTINCT grp, frame_id, distance_gt FROM f_filed) p LEFT JOIN c_refs c ON c.grp = p.grp LEFT JOIN c_value v ON v.frame_id = p.frame_id) {_USABLE}""",
    "c_res": _loo_line("o.pred", "o.gt_m", "(a * p.pred + b)", "c_q"),
    "scores": "SELECT group_key, count(*) AS n_points, avg(err_uncal) AS u, avg(err_cal) AS c FROM res_linear GROUP BY 1",
    "last_list": "SELECT anno, max(ori) AS ori FROM f_video_list WHERE anno IS NOT NULL GROUP BY 1",
    "flags": """SELECT a.*, reason FROM (SELECT a.*, f.fps, f.duration_s FROM f_annotations a LEFT JOIN f_video_fps f ON a.video_name = f.video_name) a,
      (VALUES ('VIDEO_NOT_ON_DISK'), ('FRAME_IDX_FPS_MISMATCH'), ('TIMESTAMP_PAST_END'), ('ABSURD_DISTANCE'), ('ZERO_DISTANCE')) r(reason)
      WHERE (reason = 'VIDEO_NOT_ON_DISK' AND fps IS NULL)
        OR (reason = 'FRAME_IDX_FPS_MISMATCH' AND abs(frame_idx - round_even(frame_timestamp * fps, 0)) > 1)
        OR (reason = 'TIMESTAMP_PAST_END' AND fps IS NOT NULL AND frame_timestamp > duration_s + 0.5)
        OR (reason = 'ABSURD_DISTANCE' AND distance > 100) OR (reason = 'ZERO_DISTANCE' AND distance <= 0)""",
    "refs_furthest": "SELECT grp, frame_id AS reference FROM (SELECT grp, frame_id, row_number() OVER (PARTITION BY grp ORDER BY distance_gt DESC, frame_id) AS rn FROM (SELECT DISTINCT grp, frame_id, distance_gt FROM f_pixels)) WHERE rn = 1",
    "bg": """SELECT f.frame_id, f.grp, reference, f.pos, f.depth AS x, r.depth AS y FROM f_pixels f JOIN refs_furthest USING (grp)
      JOIN f_pixels r ON r.frame_id = reference AND r.pos = f.pos
      WHERE NOT f.in_mask AND NOT r.in_mask AND NOT isnan(f.depth) AND NOT isnan(r.depth)""",
    "all_frames": "SELECT DISTINCT f.frame_id, f.grp, reference FROM f_pixels f JOIN refs_furthest USING (grp)",
    "aligned": f"""SELECT frame_id, grp, reference, CASE WHEN frame_id = reference OR n < 8 THEN 1e0 ELSE a END AS a, CASE WHEN frame_id = reference OR n < 8 THEN 0e0 ELSE b END AS b, n
      FROM (SELECT f.frame_id, f.grp, f.reference, count(pos) AS n, {_line('x', 'y')} FROM all_frames f LEFT JOIN bg USING (frame_id) GROUP BY 1, 2, 3)""",
    "w": "SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY frame_id) AS n, max(y) OVER (PARTITION BY frame_id) - min(y) OVER (PARTITION BY frame_id) AS spread FROM bg WHERE frame_id <> reference",
    "trials": """SELECT l.frame_id, t, (h.y - l.y) / (h.x - l.x) AS a, l.y - (h.y - l.y) / (h.x - l.x) * l.x AS b FROM (SELECT unnest(range(0, 200)) AS t) s
      JOIN w l ON l.i = (7919 * t + 104729 * l.frame_id) % l.n
      JOIN w h ON h.frame_id = l.frame_id AND h.i = (l.i + 1 + (6271 * t) % (l.n - 1)) % l.n
      WHERE l.n >= 8 AND l.x <> h.x AND (h.y - l.y) / (h.x - l.x) > 0""",
    "votes": """SELECT frame_id, t, a, b, (SELECT count(*) FROM w WHERE w.frame_id = trials.frame_id AND abs(w.y - (trials.a * w.x + trials.b)) < CASE WHEN w.spread > 0 THEN 0.1 * w.spread ELSE 1.0 END) AS c FROM trials""",
    "winner": "SELECT frame_id, a, b, c FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY c DESC, t) AS rn FROM votes) WHERE rn = 1 AND c >= 2",
    "refit": f"""SELECT w.frame_id, {_line('w.x', 'w.y')} FROM w JOIN winner v ON v.frame_id = w.frame_id AND abs(w.y - (v.a * w.x + v.b)) < CASE WHEN w.spread > 0 THEN 0.1 * w.spread ELSE 1.0 END GROUP BY 1""",
    "knots": f"""SELECT group_key, count(*) AS n, min(pred) AS lo, max(pred) AS hi, {_line('pred', 'gt_m', 'la', 'lb')} FROM p GROUP BY 1""",
    "tried": "SELECT k.group_key, k.k, p.pred, p.gt_m FROM (SELECT DISTINCT p.group_key, pred AS k FROM p JOIN knots USING (group_key) WHERE n >= 4 AND pred > lo AND pred < hi) k JOIN p USING (group_key)",
    "low": "SELECT group_key, k, regr_slope(gt_m, pred) AS a1, regr_intercept(gt_m, pred) AS b1 FROM tried WHERE pred <= k GROUP BY 1, 2",
    "high": "SELECT t.group_key, t.k, sum((pred - t.k) * (gt_m - (a1 * t.k + b1))) / sum((pred - t.k) * (pred - t.k)) AS a2 FROM tried t JOIN low USING (group_key, k) WHERE pred > t.k GROUP BY 1, 2",
    "sse": """SELECT t.group_key, t.k, a1, b1, a2, sum(CASE WHEN pred > t.k THEN (a1 * t.k + b1 + a2 * (pred - t.k) - gt_m) ** 2 ELSE (a1 * pred + b1 - gt_m) ** 2 END) AS sse
      FROM tried t JOIN low USING (group_key, k) JOIN high USING (group_key, k) GROUP BY 1, 2, 3, 4, 5""",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY sse, k) AS rn FROM sse) WHERE rn = 1",
}
_P = ("f_results", "points", "p")
_Q = ("f_results", "points", "q")
_A = ("f_annotations", "f_video_fps")
_B = ("f_pixels", "refs_furthest", "bg", "all_frames", "aligned")


def _points(spark, sf_dir, anchor: str = "mask_mean", excluded: bool = False) -> DataFrame:
    return points.by_clip(points.load_points(fx.results(spark, sf_dir), anchor, fx.exclusions(spark, sf_dir) if excluded else None))


_POINT_COLUMNS = ["video_name", "frame_idx", "instance_idx", "pred", "gt_m", "v"]
_POINT_SQL = "SELECT video_name, frame_idx, instance_idx, round(pred, 6) AS pred, gt_m, round(v, 6) AS v FROM "


@query("points_dedup", _POINT_SQL + "points", "f_results", "points")
def points_dedup(spark, sf_dir):
    return _round(_points(spark, sf_dir).select(_POINT_COLUMNS), "pred", "v")


@query("points_excluded", _POINT_SQL + "points_kept", "f_results", "f_exclusions", "points_kept")
def points_excluded(spark, sf_dir):
    return _round(_points(spark, sf_dir, excluded=True).select(_POINT_COLUMNS), "pred", "v")


@query("points_centroid", _POINT_SQL + "points_centroid", "f_results", "points_centroid")
def points_centroid(spark, sf_dir):
    return _round(_points(spark, sf_dir, "centroid").select(_POINT_COLUMNS), "pred", "v")


@query("group_limit", "SELECT group_key, count(*) AS n FROM points WHERE group_key IN (SELECT DISTINCT group_key FROM points ORDER BY 1 LIMIT 25) GROUP BY 1", "f_results", "points")
def group_limit(spark, sf_dir):
    return points.limit_groups(_points(spark, sf_dir), 25).groupBy("group_key").agg(F.count("*").alias("n"))


@query("eval_metrics", """SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias, min(distance_gt) AS gt_min,
  max(distance_gt) AS gt_max, round(min(depth_mask_mean), 6) AS pred_min, round(max(depth_mask_mean), 6) AS pred_max
  FROM (SELECT *, depth_mask_mean - distance_gt AS e FROM f_results WHERE status = 'processed' AND depth_mask_mean IS NOT NULL)""", "f_results")
def eval_metrics(spark, sf_dir):
    return _round(evaluate.error_metrics(fx.results(spark, sf_dir)), "mae", "rmse", "bias", "pred_min", "pred_max")


@query("status_counts", """SELECT CASE WHEN status LIKE 'sam_error:%' OR status LIKE 'depth_error:%' THEN split_part(status, ':', 1) ELSE status END AS status, count(*) AS n
  FROM f_results GROUP BY 1""", "f_results")
def status_counts(spark, sf_dir):
    return evaluate.status_counts(fx.results(spark, sf_dir))


@query("video_resolution", "SELECT ori IS NULL AS missing, count(*) AS n FROM f_annotations a LEFT JOIN (SELECT * FROM f_video_fps) f ON a.video_name = f.video_name LEFT JOIN last_list ON anno = f.video_name GROUP BY 1",
       "f_annotations", "f_video_fps", "f_video_list", "last_list")
def video_resolution(spark, sf_dir):
    known = fx.video_fps(spark, sf_dir).select(F.col("path").alias("ori"), F.col("video_name").alias("anno"))
    out = evaluate.resolve_videos(fx.annotations(spark, sf_dir), known)
    return out.groupBy(F.col("path").isNull().alias("missing")).agg(F.count("*").alias("n"))


def _flags(spark, sf_dir) -> DataFrame:
    return qc.collect_flags(fx.annotations(spark, sf_dir), fx.video_fps(spark, sf_dir))


def _numbered(spark, sf_dir) -> DataFrame:
    return qc.number_rows(fx.annotations(spark, sf_dir), "ord", (F.col("ord.l_orderkey") / 4096).cast("long"))


@query("qc_flags_long", "SELECT row_id, video_name, frame_idx, round(frame_timestamp, 6) AS frame_timestamp, distance, reason FROM flags", *_A, "flags")
def qc_flags_long(spark, sf_dir):
    flags = qc.collect_flags(_numbered(spark, sf_dir), fx.video_fps(spark, sf_dir))
    return _round(flags.select("row_id", "video_name", "frame_idx", "frame_timestamp", "distance", "reason"), "frame_timestamp")


@query("qc_flag_details", """SELECT row_id, reason, CASE reason WHEN 'FRAME_IDX_FPS_MISMATCH' THEN concat('expected frame_idx ', cast(cast(round_even(frame_timestamp * fps, 0) AS bigint) AS string), ' at fps ', cast(cast(fps AS int) AS string))
  WHEN 'TIMESTAMP_PAST_END' THEN concat('video duration ', printf('%.1f', duration_s), 's') ELSE '' END AS detail FROM flags""", *_A, "flags")
def qc_flag_details(spark, sf_dir):
    return qc.collect_flags(_numbered(spark, sf_dir), fx.video_fps(spark, sf_dir)).select("row_id", "reason", "detail")


@query("qc_flags_first", """SELECT row_id, reason FROM flags ORDER BY row_id,
  list_position(['VIDEO_NOT_ON_DISK', 'FRAME_IDX_FPS_MISMATCH', 'TIMESTAMP_PAST_END', 'ABSURD_DISTANCE', 'ZERO_DISTANCE'], reason) LIMIT 50""", *_A, "flags")
def qc_flags_first(spark, sf_dir):
    """The head of the flags file."""
    return qc.in_file_order(qc.collect_flags(_numbered(spark, sf_dir), fx.video_fps(spark, sf_dir)), "row_id").limit(50).select("row_id", "reason")


@query("qc_counts_reason", "SELECT reason, count(*) AS n FROM flags GROUP BY 1", *_A, "flags")
def qc_counts_reason(spark, sf_dir):
    return qc.counts_by_reason(_flags(spark, sf_dir))


@query("qc_counts_site", "SELECT split_part(video_name, '_', 1) AS site, count(*) AS n FROM flags GROUP BY 1", *_A, "flags")
def qc_counts_site(spark, sf_dir):
    return qc.counts_by_site(_flags(spark, sf_dir))


@query("qc_distinct_counts", "SELECT count(DISTINCT row_id) AS n_rows, count(DISTINCT video_name) AS n_videos, count(*) AS n_flags FROM flags", *_A, "flags")
def qc_distinct_counts(spark, sf_dir):
    return qc.distinct_counts(qc.collect_flags(_numbered(spark, sf_dir), fx.video_fps(spark, sf_dir)))


_CLEAN_SQL = """SELECT a.video_name, {frame} AS frame_idx, round(frame_timestamp, 6) AS frame_timestamp, distance, {mark} AS frame_idx_estimated
  FROM f_annotations a LEFT JOIN f_video_fps f ON a.video_name = f.video_name WHERE NOT (distance > 100 OR distance <= 0)"""
_CLEAN_COLUMNS = ["video_name", "frame_idx", "frame_timestamp", "distance", "frame_idx_estimated"]


@query("qc_clean_nan", _CLEAN_SQL.format(frame="cast(round_even(frame_timestamp * fps, 0) AS bigint)", mark="false"), *_A)
def qc_clean_nan(spark, sf_dir):
    return _round(qc.apply_fixes(fx.annotations(spark, sf_dir), fx.video_fps(spark, sf_dir)).select(_CLEAN_COLUMNS), "frame_timestamp")


@query("qc_clean_estimate", _CLEAN_SQL.format(frame="cast(round_even(frame_timestamp * coalesce(fps, 24e0), 0) AS bigint)", mark="fps IS NULL"), *_A)
def qc_clean_estimate(spark, sf_dir):
    return _round(qc.apply_fixes(fx.annotations(spark, sf_dir), fx.video_fps(spark, sf_dir), mode="estimate").select(_CLEAN_COLUMNS), "frame_timestamp")


@query("qc_plausible_outliers", "SELECT video_name, frame_idx, distance FROM f_annotations WHERE distance > 30 AND distance <= 100", "f_annotations")
def qc_plausible_outliers(spark, sf_dir):
    return qc.plausible_outliers(fx.annotations(spark, sf_dir)).select("video_name", "frame_idx", "distance")


@query("qc_timestamp_diff", """SELECT video_name, count(*) AS n FROM f_annotations a
  WHERE NOT EXISTS (SELECT 1 FROM f_annotations e WHERE e.distance < 20 AND e.video_name = a.video_name AND e.frame_timestamp = a.frame_timestamp) GROUP BY 1""", "f_annotations")
def qc_timestamp_diff(spark, sf_dir):
    a = fx.annotations(spark, sf_dir)
    return qc.missing_timestamps(a, a.where("distance < 20")).groupBy("video_name").agg(F.count("*").alias("n"))


@query("fps_parse_rate", "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE round((o_orderkey % 30000) / (o_custkey % 7), 6) END AS rate FROM orders")
def fps_parse_rate(spark, sf_dir):
    text = F.concat((F.col("o_orderkey") % 30000).cast("string"), F.lit("/"), (F.col("o_custkey") % 7).cast("string"))
    return fx.read(spark, sf_dir, "orders").select("o_orderkey", F.round(scalar.parse_rate(text), 6).alias("rate"))


@query("fps_histogram", "SELECT fps, count(*) AS n, count(*) FILTER (WHERE vfr) AS n_vfr FROM f_video_fps GROUP BY 1", "f_video_fps")
def fps_histogram(spark, sf_dir):
    return qc.fps_histogram(fx.video_fps(spark, sf_dir))


@query("vfr_test", "SELECT video_name, abs(fps - avg_fps) > 0.01 AS vfr FROM f_video_fps", "f_video_fps")
def vfr_test(spark, sf_dir):
    return fx.video_fps(spark, sf_dir).select("video_name", scalar.is_variable_rate(F.col("fps"), F.col("avg_fps")).alias("vfr"))


@query("fit_scale_ls", "SELECT group_key, count(*) AS n_points, round(sum(pred * gt_m) / sum(pred * pred), 6) AS s FROM p GROUP BY 1", *_P)
def fit_scale_ls(spark, sf_dir):
    return _round(calibrators.fit_scale(_points(spark, sf_dir)), "s")


@query("fit_scale_robust", "SELECT group_key, count(*) AS n_points, round(median(gt_m / pred), 6) AS s FROM p GROUP BY 1", *_P)
def fit_scale_robust(spark, sf_dir):
    return _round(calibrators.fit_scale(_points(spark, sf_dir), robust=True), "s")


_AB = "SELECT group_key, n_points, round(a, 6) AS a, round(b, 6) AS b FROM "


@query("fit_linear", _AB + f"(SELECT group_key, count(*) AS n_points, {_line('pred', 'gt_m')} FROM p GROUP BY 1)", *_P)
def fit_linear(spark, sf_dir):
    return _round(calibrators.fit_linear(_points(spark, sf_dir)), "a", "b")


@query("fit_theil_sen", _AB + """(SELECT p.group_key, count(*) AS n_points, CASE WHEN count(*) = 1 THEN min(gt_m) / min(pred) ELSE any_value(coalesce(s.a, 0)) END AS a,
  CASE WHEN count(*) = 1 THEN 0e0 ELSE median(gt_m - coalesce(s.a, 0) * pred) END AS b FROM p LEFT JOIN
  (SELECT l.group_key, median((r.gt_m - l.gt_m) / (r.pred - l.pred)) AS a FROM p l JOIN p r ON l.group_key = r.group_key AND l.pred < r.pred GROUP BY 1) s ON p.group_key = s.group_key GROUP BY 1)""", *_P)
def fit_theil_sen(spark, sf_dir):
    return _round(calibrators.fit_theil_sen(_points(spark, sf_dir)), "a", "b")


@query("fit_disparity", _AB + f"(SELECT group_key, count(*) AS n_points, {_line('(1 / pred)', '(1 / gt_m)')} FROM p GROUP BY 1)", *_P)
def fit_disparity(spark, sf_dir):
    return _round(calibrators.fit_disparity(_points(spark, sf_dir)), "a", "b")


@query("fit_piecewise", """SELECT group_key, n AS n_points, round(coalesce(a1, la), 5) AS a1, round(coalesce(b1, lb), 5) AS b1, round(coalesce(a2, la), 5) AS a2,
  coalesce(round(b.k, 6), cast('Infinity' AS double)) AS k FROM knots LEFT JOIN best b USING (group_key)""", *_P, "knots", "tried", "low", "high", "sse", "best")
def fit_piecewise(spark, sf_dir):
    fit = calibrators.fit_piecewise(_points(spark, sf_dir))
    return fit.withColumns({c: F.round(c, 5) for c in ("a1", "b1", "a2")}).withColumn("k", F.when(F.col("k") == scalar.INF, F.col("k")).otherwise(F.round("k", 6)))


@query("fit_poly")
def fit_poly(spark, sf_dir):
    return calibrators.fit_poly(_points(spark, sf_dir)).select("group_key", "n_points", F.transform("coeffs", lambda c: F.round(c, 6)).alias("coeffs"))


@query("fit_poly_at_mean", """SELECT group_key, n AS n_points, round(my - CASE WHEN n < 3 THEN 0 ELSE s2 / n * (s2w - s3 * s1w / s2) / (s4 - s3 * s3 / s2 - s2 * s2 / n) END, 4) AS value
  FROM (SELECT group_key, any_value(n) AS n, any_value(my) AS my, sum(u ** 2) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4, sum(u * w) AS s1w, sum(u * u * w) AS s2w
    FROM (SELECT *, pred - mx AS u, gt_m - my AS w FROM (SELECT *, count(*) OVER g AS n, avg(pred) OVER g AS mx, avg(gt_m) OVER g AS my FROM p WINDOW g AS (PARTITION BY group_key))) GROUP BY 1)""", *_P)
def fit_poly_at_mean(spark, sf_dir):
    """Quadratics evaluated at the mean prediction, which normal equations repeat well."""
    own = _points(spark, sf_dir)
    middle = points.clean(own).groupBy("group_key").agg(F.avg("pred").alias("mx"))
    fit = calibrators.fit_poly(own).join(middle, "group_key")
    return fit.select("group_key", "n_points", F.round(calibrators.predict("poly", F.col("mx"), {"coeffs": F.col("coeffs")}), 4).alias("value"))


@query("fit_poly2d")
def fit_poly2d(spark, sf_dir):
    return calibrators.fit_poly2d(_points(spark, sf_dir)).select("group_key", "n_points", F.transform("coeffs", lambda c: F.round(c, 6)).alias("coeffs"))


def _scores(residuals: DataFrame) -> DataFrame:
    return _round(loo.group_scores(residuals), "loo_mae_uncal", "loo_mae_cal", "improvement")


def _score_sql(source: str) -> str:
    return f"""SELECT group_key, count(*) AS n_points, round(avg(err_uncal), 6) AS loo_mae_uncal, round(avg(err_cal), 6) AS loo_mae_cal,
      round(avg(err_uncal) - avg(err_cal), 6) AS improvement FROM {source} GROUP BY 1"""


for _method, _source in (("scale", "res_scale"), ("linear", "res_linear"), ("disparity", "res_disparity")):
    def _run(spark, sf_dir, method=_method):
        return _scores(loo.loo(_points(spark, sf_dir), method))

    query(f"loo_{_method}", _score_sql(_source), *_Q, _source)(_run)

_PIECES = ("others", "o_ends", "o_tried", "o_low", "o_high", "o_best", "res_piecewise")
for _name, _method, _options, _ctes in (("loo_theil_sen", "linear", {"robust": True}, ("res_theil_sen",)), ("loo_piecewise", "piecewise", {}, _PIECES), ("loo_poly", "poly", {"degree": 2}, ()),
                                        ("loo_poly2d", "poly2d", {}, ()), ("loo_scale_robust", "scale", {"robust": True}, ("res_scale_robust",))):
    def _run(spark, sf_dir, method=_method, options=_options):
        return _scores(loo.loo(_points(spark, sf_dir), method, **options))

    query(_name, _score_sql(_ctes[-1]) if _ctes else None, *_Q, *_ctes)(_run)


@query("loo_summary", """SELECT count(*) AS n_groups_total, count(c) AS n_groups_scored, round(avg(u) FILTER (WHERE c IS NOT NULL), 6) AS mean_loo_mae_uncal, round(avg(c), 6) AS mean_loo_mae_cal,
  count(*) FILTER (WHERE c < u) AS n_groups_improved, round(avg(u) FILTER (WHERE c IS NOT NULL) - avg(c), 6) AS mean_improvement,
  round(100.0 * count(*) FILTER (WHERE c < u) / count(c), 6) AS pct_groups_improved FROM scores""", *_Q, "res_linear", "scores")
def loo_summary(spark, sf_dir):
    out = loo.summary(loo.group_scores(loo.loo_linear(_points(spark, sf_dir))))
    return _round(out, "mean_loo_mae_uncal", "mean_loo_mae_cal", "mean_improvement", "pct_groups_improved")


_BUCKET_SQL = ", ".join(f"""count(*) FILTER (WHERE gt_m >= {lo} AND gt_m < {hi} AND err_cal IS NOT NULL) AS {n}_n, round(avg(err_uncal) FILTER (WHERE gt_m >= {lo} AND gt_m < {hi} AND err_cal IS NOT NULL), 6) AS {n}_mae_uncal,
  round(avg(err_cal) FILTER (WHERE gt_m >= {lo} AND gt_m < {hi}), 6) AS {n}_mae_cal""" for n, lo, hi in (("close", 1, 4), ("medium", 4, 8), ("long", 8, "1e300")))


@query("loo_buckets", f"SELECT {_BUCKET_SQL}, count(*) FILTER (WHERE gt_m < 1 AND err_cal IS NOT NULL) AS below_1m_n FROM res_linear", *_Q, "res_linear")
def loo_buckets(spark, sf_dir):
    out = loo.buckets(loo.loo_linear(_points(spark, sf_dir)))
    return _round(out, *(c for c in out.columns if "mae" in c))


@query("camera_key", "SELECT anno AS video_name, regexp_replace(ori, '/[^/]+$', '') AS camera FROM last_list", "f_video_list", "last_list")
def camera_key(spark, sf_dir):
    return points.camera_keys(fx.video_list(spark, sf_dir)).select(F.col("anno").alias("video_name"), "camera")


@query("camera_level_fit", f"""SELECT camera AS group_key, n_points, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT regexp_replace(ori, '/[^/]+$', '') AS camera, count(*) AS n_points, {_line('pred', 'gt_m')}
  FROM p JOIN last_list ON anno = video_name GROUP BY 1)""", *_P, "f_video_list", "last_list")
def camera_level_fit(spark, sf_dir):
    own = points.load_points(fx.results(spark, sf_dir))
    return _round(calibrators.fit_linear(points.by_camera(own, fx.video_list(spark, sf_dir))), "a", "b")


@query("sweep_grid", """SELECT row_number() OVER (ORDER BY ao, mo, dg NULLS FIRST, rb) - 1 AS sweep_ord, anchor, method, dg AS degree, rb AS robust
  FROM (VALUES (0, 'mask_mean'), (1, 'centroid')) a(ao, anchor), (VALUES (0, 'scale', NULL, false), (0, 'scale', NULL, true), (1, 'linear', NULL, false), (1, 'linear', NULL, true),
  (2, 'disparity', NULL, NULL), (3, 'poly', 1, NULL), (3, 'poly', 2, NULL), (3, 'poly', 3, NULL), (4, 'poly2d', NULL, NULL), (5, 'piecewise', NULL, NULL)) m(mo, method, dg, rb)""")
def sweep_grid(spark, sf_dir):
    return sw.grid_frame(spark).select("sweep_ord", "anchor", "method", "degree", "robust")


@query("sweep_all")
def sweep_all(spark, sf_dir):
    out = sw.sweep(fx.results(spark, sf_dir))
    return _round(out, *(c for c, kind in out.dtypes if kind == "double"))


@query("sweep_ranked")
def sweep_ranked(spark, sf_dir):
    out = sw.ranked(sw.sweep(fx.results(spark, sf_dir)))
    return _round(out, *(c for c, kind in out.dtypes if kind == "double"))


_COMBOS = [(anchor, method, robust, f"res_{name}{end}") for anchor, end in (("mask_mean", ""), ("centroid", "_centroid"))
           for method, robust, name in (("scale", False, "scale"), ("scale", True, "scale_robust"), ("linear", False, "linear"), ("linear", True, "theil_sen"), ("disparity", None, "disparity"))]
_SWEEP_BUCKETS = ", ".join(f"""coalesce(sum(n) FILTER (WHERE gt_m >= {lo} AND gt_m < {hi} AND c IS NOT NULL), 0)::BIGINT AS {b}_n, round(sum(u) FILTER (WHERE gt_m >= {lo} AND gt_m < {hi} AND c IS NOT NULL)
  / sum(n) FILTER (WHERE gt_m >= {lo} AND gt_m < {hi} AND c IS NOT NULL), 6) AS {b}_mae_uncal, round(sum(c) FILTER (WHERE gt_m >= {lo} AND gt_m < {hi}) / sum(n) FILTER (WHERE gt_m >= {lo} AND gt_m < {hi} AND c IS NOT NULL), 6) AS {b}_mae_cal"""
                           for b, lo, hi in (("close", 1, 4), ("medium", 4, 8), ("long", 8, "1e300")))


def _swept_sql(i: int, anchor: str, method: str, robust: bool | None, source: str) -> str:
    return f"""SELECT {i} AS sweep_ord, '{anchor}' AS anchor, '{method}' AS method, cast({'NULL' if robust is None else str(robust).lower()} AS boolean) AS robust, g.*, b.* FROM
      (SELECT count(*) AS n_groups_total, count(c) AS n_groups_scored, round(avg(u) FILTER (WHERE c IS NOT NULL), 6) AS mean_loo_mae_uncal, round(avg(c), 6) AS mean_loo_mae_cal,
        round(avg(u) FILTER (WHERE c IS NOT NULL) - avg(c), 6) AS mean_improvement, round(100.0 * count(*) FILTER (WHERE c < u) / count(c), 6) AS pct_groups_improved
        FROM (SELECT group_key, avg(err_uncal) AS u, avg(err_cal) AS c FROM {source} GROUP BY 1)) g,
      (SELECT {_SWEEP_BUCKETS} FROM (SELECT gt_m, err_uncal AS u, err_cal AS c, 1 AS n FROM {source})) b"""


_SWEPT = " UNION ALL ".join(_swept_sql(i, *c) for i, c in enumerate(_COMBOS))
_SWEEP_CTES = ("f_results", "points", "q", "points_centroid", "q_centroid", *(c[-1] for c in _COMBOS))
_SWEEP_COLUMNS = ["sweep_ord", "anchor", "method", "robust", "n_groups_total", "n_groups_scored", "mean_loo_mae_uncal", "mean_loo_mae_cal", "mean_improvement", "pct_groups_improved",
                  *(f"{b}_{c}" for b in ("close", "medium", "long") for c in ("n", "mae_uncal", "mae_cal"))]


def _swept(spark, sf_dir) -> DataFrame:
    return sw.sweep(fx.results(spark, sf_dir), methods=("scale", "linear", "disparity")).select(_SWEEP_COLUMNS)


@query("sweep_lines", _SWEPT, *_SWEEP_CTES)
def sweep_lines(spark, sf_dir):
    """The combinations whose refits SQL can repeat."""
    out = _swept(spark, sf_dir)
    return _round(out, *(c for c, kind in out.dtypes if kind == "double"))


@query("sweep_lines_ranked", f"SELECT * FROM ({_SWEPT}) ORDER BY mean_improvement DESC NULLS LAST, sweep_ord LIMIT 4", *_SWEEP_CTES)
def sweep_lines_ranked(spark, sf_dir):
    out = sw.ranked(_swept(spark, sf_dir), n=4)
    return _round(out, *(c for c, kind in out.dtypes if kind == "double"))


@query("calibrate_aligned", f"""SELECT 'cam' AS calib_level, f.group_key, 'linear' AS method, 'mask_mean' AS anchor, n_points, round(a, 5) AS a, round(b, 5) AS b, round(u, 6) AS loo_mae_uncal,
  round(c, 6) AS loo_mae_cal, round(u - c, 6) AS improvement, 'least_squares' AS align_method, reference IS NOT NULL AS align_applied, CASE WHEN reference IS NULL THEN NULL ELSE f.group_key END AS align_ref_video,
  cast(reference AS int) AS align_ref_frame_idx, CASE reference % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS align_ref_instance_idx
  FROM (SELECT group_key, any_value(reference) AS reference, count(*) AS n_points, {_line('pred', 'gt_m')} FROM c_q GROUP BY 1) f
  JOIN (SELECT group_key, avg(err_uncal) AS u, avg(err_cal) AS c FROM c_res GROUP BY 1) r ON r.group_key = f.group_key""", "f_pixels", "f_filed", "c_refs", "c_bg", "c_line", "c_value", "c_q", "c_res")
def calibrate_aligned(spark, sf_dir):
    """Points aligned on maps and masks, with the gate and the fall-backs, fitted and reported."""
    fits, _ = cal.calibrate(fx.filed_points(spark, sf_dir), "linear", calib_level="cam", maps=fx.map_files(spark, sf_dir), masks=fx.mask_files(spark, sf_dir), align="least_squares", min_points=45)
    number = lambda k, n: F.round(F.get_json_object("params", f"$.{k}").cast("double"), n).alias(k)
    out = fits.select("calib_level", "group_key", "method", "anchor", "n_points", number("a", 5), number("b", 5), "loo_mae_uncal", "loo_mae_cal", "improvement", "align_method",
                      "align_applied", "align_ref_video", "align_ref_frame_idx", "align_ref_instance_idx")
    return _round(out, "loo_mae_uncal", "loo_mae_cal", "improvement")


@query("ref_frame_furthest", "SELECT grp, reference FROM refs_furthest", "f_pixels", "refs_furthest")
def ref_frame_furthest(spark, sf_dir):
    return align.pick_reference(fx.frames(spark, sf_dir))


@query("ref_frame_median", """SELECT grp, frame_id AS reference FROM (SELECT grp, frame_id, row_number() OVER (PARTITION BY grp ORDER BY abs(distance_gt - m), frame_id) AS rn
  FROM (SELECT *, median(distance_gt) OVER (PARTITION BY grp) AS m FROM (SELECT DISTINCT grp, frame_id, distance_gt FROM f_pixels))) WHERE rn = 1""", "f_pixels")
def ref_frame_median(spark, sf_dir):
    return align.pick_reference(fx.frames(spark, sf_dir), "median")


_AB_FRAME = "SELECT frame_id, grp, reference, round(a, 6) AS a, round(b, 6) AS b, n FROM "


@query("align_background", _AB_FRAME + "aligned", *_B)
def align_background(spark, sf_dir):
    return _round(align.align_least_squares(fx.frames(spark, sf_dir)), "a", "b")


@query("align_ransac", _AB_FRAME + """(SELECT frame_id, l.grp, l.reference, l.n, CASE WHEN frame_id = l.reference OR l.n < 8 THEN 1e0 WHEN r.a > 0 THEN r.a ELSE l.a END AS a,
  CASE WHEN frame_id = l.reference OR l.n < 8 THEN 0e0 WHEN r.a > 0 THEN r.b ELSE l.b END AS b FROM aligned l LEFT JOIN refit r USING (frame_id))""", *_B, "w", "trials", "votes", "winner", "refit")
def align_ransac(spark, sf_dir):
    return _round(align.align_ransac(fx.frames(spark, sf_dir)), "a", "b")


@query("align_ransac_seeded")
def align_ransac_seeded(spark, sf_dir):
    return _round(align.align_ransac(fx.frames(spark, sf_dir), seeded=True), "a", "b")


@query("aligned_subject", """SELECT a.frame_id, round(median(a.a * depth + a.b), 6) AS value, CASE WHEN count(depth) = 0 THEN 'no_finite_pixel' ELSE 'aligned' END AS status
  FROM aligned a LEFT JOIN f_pixels f ON a.frame_id = f.frame_id AND in_mask AND NOT isnan(depth) GROUP BY 1""", *_B)
def aligned_subject(spark, sf_dir):
    frames = fx.frames(spark, sf_dir)
    return _round(align.aligned_subject(frames, align.align_least_squares(frames)), "value")


def _applied(spark, sf_dir, method: str, **params) -> DataFrame:
    lit = {k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, v in params.items()}
    out = fx.frames(spark, sf_dir).select("frame_id", maps.apply_map(method, F.col("depth"), lit, F.col("h"), F.col("w")).alias("c"))
    good = maps.finite(F.col("c"))
    return out.select("frame_id", F.size(good).alias("n"), F.round(maps.mean_of(F.transform(good, lambda x: x.cast("double"))), 4).alias("mean"))


def _applied_sql(value: str) -> str:
    """Maps reduced to the number and mean of their finite pixels, kept as 32-bit values."""
    return f"""SELECT frame_id, cast(count(c) FILTER (WHERE isfinite(c)) AS int) AS n, round(avg(cast(c AS double)) FILTER (WHERE isfinite(c)), 4) AS mean FROM
      (SELECT frame_id, cast(CASE WHEN isfinite(depth) AND depth > 0 THEN CASE WHEN isfinite({value}) AND {value} > 0 THEN {value} ELSE cast('NaN' AS double) END ELSE depth END AS float) AS c FROM f_pixels) GROUP BY 1"""


@query("apply_scale_map", _applied_sql("(1.7e0 * depth)"), "f_pixels")
def apply_scale_map(spark, sf_dir):
    return _applied(spark, sf_dir, "scale", s=1.7)


@query("apply_linear_map", _applied_sql("(-1.5e0 * depth + 8e0)"), "f_pixels")
def apply_linear_map(spark, sf_dir):
    return _applied(spark, sf_dir, "linear", a=-1.5, b=8.0)


@query("apply_disparity_map", _applied_sql("(1 / (0.9e0 / depth + 0.011e0))"), "f_pixels")
def apply_disparity_map(spark, sf_dir):
    return _applied(spark, sf_dir, "disparity", a=0.9, b=0.011)


@query("apply_piecewise_map", _applied_sql("(CASE WHEN depth <= 5.5e0 THEN 2 * depth + 1 ELSE 12e0 + 5 * (depth - 5.5e0) END)"), "f_pixels")
def apply_piecewise_map(spark, sf_dir):
    return _applied(spark, sf_dir, "piecewise", a1=2.0, b1=1.0, a2=5.0, k=5.5)


@query("apply_poly2d_rows", _applied_sql("(1 + 0.5e0 * depth + 2e0 * ((floor(pos / 8) + 0.5e0) / 8))"), "f_pixels")
def apply_poly2d_rows(spark, sf_dir):
    return _applied(spark, sf_dir, "poly2d", coeffs=[1.0, 0.5, 2.0])


@query("mask_mean", "SELECT frame_id, round(avg(depth) FILTER (WHERE in_mask AND NOT isnan(depth)), 6) AS mean, round(median(depth) FILTER (WHERE in_mask AND NOT isnan(depth)), 6) AS median FROM f_pixels GROUP BY 1", "f_pixels")
def mask_mean(spark, sf_dir):
    inside = maps.in_mask(F.col("depth"), F.col("mask"))
    return _round(fx.frames(spark, sf_dir).select("frame_id", maps.mean_of(inside).alias("mean"), maps.median_of(inside).alias("median")), "mean", "median")


_BOX = "SELECT frame_id, cast(count(*) AS int) AS area, cast(min(pos % 8) AS int) AS min_x, cast(max(pos % 8) AS int) AS max_x, cast(min(floor(pos / 8)) AS int) AS min_y, cast(max(floor(pos / 8)) AS int) AS max_y FROM f_pixels WHERE in_mask GROUP BY 1"


def _geometry(spark, sf_dir) -> DataFrame:
    return fx.frames(spark, sf_dir).select("*", maps.mask_geometry(F.col("mask"), F.col("w")).alias("g"))


@query("mask_bbox_area", f"SELECT *, cast(floor((min_x + max_x) / 2) AS int) AS center_x, cast(floor((min_y + max_y) / 2) AS int) AS center_y FROM ({_BOX})", "f_pixels")
def mask_bbox_area(spark, sf_dir):
    return _geometry(spark, sf_dir).where("g is not null").select("frame_id", "g.*")


@query("mask_centroid", f"""SELECT b.frame_id, CASE WHEN isnan(depth) THEN NULL ELSE round(depth, 6) END AS depth_centroid, (floor((min_y + max_y) / 2) + 0.5) / 8 AS center_y_norm
  FROM ({_BOX}) b JOIN f_pixels f ON f.frame_id = b.frame_id AND f.pos = floor((min_y + max_y) / 2) * 8 + floor((min_x + max_x) / 2)""", "f_pixels")
def mask_centroid(spark, sf_dir):
    value = maps.value_at(F.col("depth"), F.col("g.center_x"), F.col("g.center_y"), F.col("w"))
    return _geometry(spark, sf_dir).where("g is not null").select("frame_id", F.round(value, 6).alias("depth_centroid"), maps.center_row(F.col("g.center_y"), F.col("h")).alias("center_y_norm"))


@query("mask_rle_runs", """SELECT frame_id, string_agg(cast(len AS string), ',' ORDER BY first) AS runs FROM (SELECT frame_id, min(o) AS first, count(*) AS len FROM
  (SELECT frame_id, o, in_mask, o - row_number() OVER (PARTITION BY frame_id, in_mask ORDER BY o) AS island FROM (SELECT frame_id, in_mask, (pos % 8) * 8 + floor(pos / 8) AS o FROM f_pixels)) GROUP BY frame_id, in_mask, island
  UNION ALL SELECT frame_id, -1 AS first, 0 AS len FROM f_pixels WHERE pos = 0 AND in_mask) GROUP BY 1""", "f_pixels")
def mask_rle_runs(spark, sf_dir):
    return fx.frames(spark, sf_dir).select("frame_id", F.concat_ws(",", F.transform(maps.mask_runs(F.col("mask"), 8, 8), lambda x: x.cast("string"))).alias("runs"))


@query("mask_rle_codec")
def mask_rle_codec(spark, sf_dir):
    size = F.array("h", "w")
    packed = fx.frames(spark, sf_dir).select("frame_id", "mask", size.alias("size"), maps.encode_masks(size, F.col("mask")).alias("counts"))
    back = maps.decode_masks(F.col("size"), F.col("counts"))
    return packed.select("frame_id", "counts", (back == F.col("mask")).alias("same"))


@query("colorize_norm", """SELECT frame_id, cast(sum(c) AS bigint) AS total, cast(max(c) AS int) AS top FROM (SELECT frame_id, CASE WHEN isnan(depth) OR hi = lo THEN 0 ELSE floor((depth - lo) / (hi - lo) * 255) END AS c
  FROM (SELECT *, min(depth) FILTER (WHERE NOT isnan(depth)) OVER (PARTITION BY frame_id) AS lo, max(depth) FILTER (WHERE NOT isnan(depth)) OVER (PARTITION BY frame_id) AS hi FROM f_pixels)) GROUP BY 1""", "f_pixels")
def colorize_norm(spark, sf_dir):
    out = fx.frames(spark, sf_dir).select("frame_id", maps.colour_index(F.col("depth")).alias("c"))
    return out.select("frame_id", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("c").alias("top"))


@query("export_pairs", """SELECT r.video_name, r.frame_idx FROM (SELECT DISTINCT video_name, frame_idx FROM f_results ANTI JOIN f_exclusions USING (video_name, frame_idx) WHERE status = 'processed') r
  JOIN (SELECT DISTINCT video_name, cast(cast(row_id % 9 + 1 AS int) * 25 AS int) AS frame_idx FROM f_results) f USING (video_name, frame_idx)""", "f_results", "f_exclusions")
def export_pairs(spark, sf_dir):
    r = fx.results(spark, sf_dir)
    names = r.where("status = 'processed'").select(F.concat(F.lit("/maps/"), scalar.frame_file(F.col("video_name"), F.col("frame_idx"), "calib.npy")).alias("path"))
    numbered = qc.number_rows(r, "ord", (F.col("ord.l_orderkey") / 4096).cast("long"))
    decoded = numbered.select("video_name", ((F.col("row_id") % 9 + 1) * 25).cast("int").alias("frame_idx"))
    return export.export_pairs(export.list_calibrated(names), decoded, fx.exclusions(spark, sf_dir)).select("video_name", "frame_idx")


@query("instance_order", """SELECT video_name, frame_idx, instance_idx, row_number() OVER (PARTITION BY video_name, frame_idx ORDER BY v, instance_idx NULLS FIRST) - 1 AS place FROM points""", "f_results", "points")
def instance_order(spark, sf_dir):
    one = F.struct("instance_idx", F.lit(1).alias("area"), F.col("v").alias("center_x"))
    found = _points(spark, sf_dir).groupBy("video_name", "frame_idx").agg(F.sort_array(F.collect_list(one)).alias("found"))
    numbered = found.select("video_name", "frame_idx", F.explode(maps.number_instances(F.col("found"))).alias("m"))
    return numbered.select("video_name", "frame_idx", F.col("m.instance.instance_idx").alias("instance_idx"), F.col("m.instance_idx").cast("long").alias("place"))


@query("fits_report", f"""SELECT 'clip' AS calib_level, f.group_key, 'linear' AS method, 'mask_mean' AS anchor, f.n_points, round(a, 6) AS a, round(b, 6) AS b, round(u, 6) AS loo_mae_uncal, round(c, 6) AS loo_mae_cal, round(u - c, 6) AS improvement
  FROM (SELECT group_key, count(*) AS n_points, {_line('pred', 'gt_m')} FROM q GROUP BY 1) f JOIN scores s ON f.group_key = s.group_key""", *_Q, "res_linear", "scores")
def fits_report(spark, sf_dir):
    own = _points(spark, sf_dir)
    both = calibrators.fit_linear(own).join(loo.group_scores(loo.loo_linear(own)).drop("n_points"), "group_key")
    out = both.select(F.lit("clip").alias("calib_level"), "group_key", F.lit("linear").alias("method"), F.lit("mask_mean").alias("anchor"), "n_points", "a", "b", "loo_mae_uncal", "loo_mae_cal", "improvement")
    return _round(out, "a", "b", "loo_mae_uncal", "loo_mae_cal", "improvement")
