"""SQL for DuckDB, written apart from the Spark plans: ranks where they take minima, joins where they use window frames."""

from __future__ import annotations

from ..sources.track_view import CTE

TRACKS = CTE.format(lineitem="lineitem")
BY = "PARTITION BY source_file, id"


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + CAST(0 AS DOUBLE))"


#: Rows of the five-point quadratic fit, times 35.
FIVE = [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]]
_W5 = ", ".join(f"({i}, {j}, CAST({v} AS DOUBLE) / 35)" for i, row in enumerate(FIVE) for j, v in enumerate(row))
NUMBERED = f"numbered AS (SELECT *, row_number() OVER ({BY} ORDER BY frame) - 1 AS p, count(*) OVER ({BY}) AS n FROM tracks)"
SMOOTHED = f"""w5(r, j, v) AS (VALUES {_W5}),
fitted AS (
  SELECT a.source_file, a.id, a.frame, sum(w.v * b.x) AS x_smooth, sum(w.v * b.y) AS y_smooth
  FROM numbered a JOIN w5 w ON w.r = CASE WHEN a.p < 2 THEN a.p WHEN a.p > a.n - 3 THEN 5 - a.n + a.p ELSE 2 END
  JOIN numbered b ON b.source_file = a.source_file AND b.id = a.id AND b.p = a.p - w.r + w.j
  GROUP BY ALL),
smoothed AS (SELECT n.*, f.x_smooth, f.y_smooth FROM numbered n JOIN fitted f USING (source_file, id, frame))"""
DOWN = "down AS (SELECT * EXCLUDE (p, n), CAST(p // 2 AS BIGINT) AS pos FROM smoothed WHERE p % 2 = 0)"


def _slope(c: str) -> str:
    t = f"OVER ({BY} ORDER BY frame)"
    return f"CASE WHEN count(*) OVER ({BY}) < 2 THEN 0 WHEN lag(frame) {t} IS NULL THEN (lead({c}) {t} - {c}) / CAST(0.2 AS DOUBLE) WHEN lead(frame) {t} IS NULL THEN ({c} - lag({c}) {t}) / CAST(0.2 AS DOUBLE) ELSE (lead({c}) {t} - lag({c}) {t}) / CAST(0.4 AS DOUBLE) END"


KIN = f"""speeds AS (SELECT *, {_slope('x_smooth')} AS vx_recomputed, {_slope('y_smooth')} AS vy_recomputed FROM down),
kin AS (SELECT *, {_slope('vx_recomputed')} AS ax_recomputed, {_slope('vy_recomputed')} AS ay_recomputed FROM speeds)"""
SEG = f"""gapped AS (SELECT *, frame - lag(frame) OVER ({BY} ORDER BY frame) AS frame_gap FROM kin),
modes AS (SELECT source_file, id, frame_gap AS mode_gap FROM (
  SELECT source_file, id, frame_gap, row_number() OVER ({BY} ORDER BY count(*) DESC, frame_gap) AS k
  FROM gapped WHERE frame_gap IS NOT NULL GROUP BY source_file, id, frame_gap) WHERE k = 1),
seg AS (SELECT g.*, m.mode_gap, CAST(sum(CASE WHEN frame_gap <> mode_gap THEN 1 ELSE 0 END) OVER ({BY} ORDER BY frame) AS BIGINT) AS segment_id
  FROM gapped g LEFT JOIN modes m USING (source_file, id))"""
WIN = """placed AS (SELECT *, row_number() OVER (PARTITION BY source_file, id, segment_id ORDER BY frame) - 1 AS q, count(*) OVER (PARTITION BY source_file, id, segment_id) AS sn FROM seg),
win AS (SELECT concat(source_file, '_', id, '_', pos) AS window_id, source_file, dataset_name, id AS vehicle_id, segment_id, pos AS start_frame, pos + 40 AS end_frame,
  pos * CAST(0.2 AS DOUBLE) AS start_time_sec, (pos + 39) * CAST(0.2 AS DOUBLE) AS end_time_sec, 15 AS n_frames_hist, 25 AS n_frames_fut,
  CAST(10 AS DOUBLE) AS source_freq_hz, CAST(5 AS DOUBLE) AS target_freq_hz
  FROM placed WHERE q % 5 = 0 AND q + 40 <= sn)"""
SCENE = """anc AS (SELECT w.window_id, w.source_file, s.id AS e_id, s.frame AS e_frame, s.x AS ex, s.y AS ey, s.xVelocity AS evx, s.yVelocity AS evy, s.laneId AS e_lane,
  CASE WHEN s.xVelocity >= 0 THEN 1 WHEN s.xVelocity < 0 THEN -1 END AS dir
  FROM win w JOIN seg s ON s.source_file = w.source_file AND s.id = w.vehicle_id AND s.pos = w.start_frame + 14),
scene AS (SELECT a.*, o.id AS o_id, o.x AS ox, o.y AS oy, o.xVelocity AS ovx, o.yVelocity AS ovy, o.laneId AS o_lane, (o.x - a.ex) * a.dir AS dx, (o.y - a.ey) * a.dir AS dy
  FROM anc a JOIN seg o ON o.source_file = a.source_file AND o.frame = a.e_frame WHERE o.xVelocity * a.dir >= 0 OR abs(o.xVelocity) < 1),
sided AS (SELECT *, CASE WHEN dy < CAST(-1.8 AS DOUBLE) THEN 'left' WHEN dy > CAST(1.8 AS DOUBLE) THEN 'right' END AS side,
  CASE WHEN dx > 5 THEN 'preceding' WHEN dx < -5 THEN 'following' ELSE 'alongside' END AS place FROM scene WHERE o_id <> e_id),
best AS (SELECT * FROM (SELECT *, concat(side, '_', place) AS slot, row_number() OVER (PARTITION BY window_id, side, place ORDER BY abs(dx), o_id) AS k FROM sided WHERE side IS NOT NULL) WHERE k = 1),
slot_names(slot_no, slot) AS (VALUES (0, 'left_preceding'), (1, 'left_alongside'), (2, 'left_following'), (3, 'right_preceding'), (4, 'right_alongside'), (5, 'right_following')),
slots AS (SELECT a.window_id, n.slot_no, n.slot, CASE WHEN b.o_id IS NULL THEN 0 ELSE 1 END AS mask, b.o_id AS id, b.ox AS x, b.oy AS y, b.ovx AS vx, b.ovy AS vy, b.o_lane AS lane,
  CAST(NULL AS DOUBLE) AS ttc, 0 AS ttc_valid, CASE WHEN n.slot LIKE '%preceding' THEN abs(b.ox - a.ex) / (abs(a.evx) + CAST(0.000001 AS DOUBLE)) END AS thw, b.ovx - a.evx AS rel_vx, b.ovy - a.evy AS rel_vy
  FROM anc a CROSS JOIN slot_names n LEFT JOIN best b ON b.window_id = a.window_id AND b.slot = n.slot)"""
LANES = """lanes AS (SELECT w.window_id, w.source_file, w.vehicle_id AS id, w.start_frame,
  CASE WHEN count(DISTINCT s.laneId) > 1 OR abs(arg_max(s.y_smooth, s.pos) - arg_min(s.y_smooth, s.pos)) > CAST(1.75 AS DOUBLE) THEN 1 ELSE 0 END AS is_lane_change
  FROM win w JOIN seg s ON s.source_file = w.source_file AND s.id = w.vehicle_id AND s.pos >= w.start_frame AND s.pos < w.end_frame GROUP BY ALL)"""
DENSITY = "density AS (SELECT window_id, CAST(count(*) - 1 AS INTEGER) AS scene_density FROM scene GROUP BY window_id)"
SPLIT = """bounds AS (SELECT source_file, min(start_time_sec) AS t0, max(end_time_sec) - min(start_time_sec) AS total FROM win GROUP BY source_file),
cuts AS (SELECT w.*, t0 + total * CAST(0.7 AS DOUBLE) AS c1, t0 + total * (CAST(0.7 AS DOUBLE) + CAST(0.1 AS DOUBLE)) AS c2, (start_time_sec + end_time_sec) / 2 AS center FROM win w JOIN bounds USING (source_file)),
zoned AS (SELECT *, CASE WHEN (start_time_sec < c1 + 4 AND end_time_sec > c1 - 4) OR (start_time_sec < c2 + 4 AND end_time_sec > c2 - 4) THEN 'gap'
  WHEN center > c2 + 4 THEN 'test' WHEN center > c1 + 4 AND center <= c2 - 4 THEN 'val' ELSE 'train' END AS split FROM cuts),
kept AS (SELECT * EXCLUDE (c1, c2, center) FROM zoned WHERE split <> 'gap')"""
#: States as the samples hold them, in single precision.
STATES = """states AS (SELECT source_file, id, pos, count(*) OVER (PARTITION BY source_file, id) AS n, CAST(x_smooth AS FLOAT) AS x, CAST(y_smooth AS FLOAT) AS y, CAST(xVelocity AS FLOAT) AS vx, CAST(yVelocity AS FLOAT) AS vy FROM seg),
ego AS (SELECT w.window_id, s.pos - w.start_frame AS t, s.x, s.y, s.vx, s.vy FROM win w JOIN states s ON s.source_file = w.source_file AND s.id = w.vehicle_id AND s.pos >= w.start_frame AND s.pos < w.end_frame),
near AS (SELECT b.window_id, b.slot, b.o_id, w.source_file, w.start_frame, w.end_frame, t.n FROM best b JOIN win w USING (window_id)
  JOIN (SELECT DISTINCT source_file, id, n FROM states) t ON t.source_file = w.source_file AND t.id = b.o_id),
near_first AS (SELECT *, CASE WHEN n < end_frame THEN greatest(n - 15, 0) ELSE start_frame END AS f, CASE WHEN n < end_frame THEN least(n, 15) ELSE 15 END AS have FROM near),
near_hist AS (SELECT h.window_id, h.slot, CAST(i.t AS BIGINT) AS t, s.x, s.y, s.vx, s.vy FROM near_first h CROSS JOIN range(15) i(t)
  JOIN states s ON s.source_file = h.source_file AND s.id = h.o_id AND s.pos = h.f + greatest(i.t - (15 - h.have), 0))"""
TRACK_STEPS = f"""stepped AS (SELECT source_file, id, frame, frame - lag(frame) OVER t AS gap, x - lag(x) OVER t AS dx, (xVelocity + lag(xVelocity) OVER t) / 2 AS v, CAST(global_time_ms - lag(global_time_ms) OVER t AS DOUBLE) AS dt
  FROM tracks WINDOW t AS ({BY} ORDER BY frame)),
gap_counts AS (SELECT source_file, gap, count(*) AS n FROM stepped WHERE gap IS NOT NULL GROUP BY ALL),
ranked_gaps AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, gap) AS rank, sum(n) OVER (PARTITION BY source_file) AS samples FROM gap_counts),
mode_gap AS (SELECT source_file, gap AS mode_gap, n / samples AS confidence FROM ranked_gaps WHERE rank = 1)"""
CHAIN = [TRACKS, NUMBERED, SMOOTHED, DOWN, KIN, SEG, WIN]


def _sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _from_win(select: str, *more: str) -> str:
    return _sql(select, *CHAIN, *more)


_VELOCITY = f"""tried AS (SELECT s.source_file, f.freq_hz, s.dx * f.freq_hz / m.mode_gap / s.v AS ratio FROM stepped s JOIN mode_gap m ON m.source_file = s.source_file AND m.mode_gap = s.gap
  CROSS JOIN (SELECT CAST(unnest([10, 25, 30, 50]) AS DOUBLE) AS freq_hz) f WHERE abs(s.v) > 1),
fits AS (SELECT source_file, freq_hz, count(*) AS samples, quantile_cont(abs(ln(abs(ratio) + CAST(0.00000001 AS DOUBLE))), 0.5) AS residual FROM tried GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY residual, freq_hz) AS k, lead(residual) OVER (PARTITION BY source_file ORDER BY residual, freq_hz) AS second FROM fits)"""
_SPREADS = """base AS (SELECT *, (x - lag(x) OVER t) * 10 AS vx, (y - lag(y) OVER t) * 10 AS vy, (x_smooth - lag(x_smooth) OVER t) * 10 AS vxs, (y_smooth - lag(y_smooth) OVER t) * 10 AS vys FROM smoothed WHERE n >= 4 WINDOW t AS (PARTITION BY source_file, id ORDER BY frame)),
accel AS (SELECT *, (vx - lag(vx) OVER t) * 10 AS ax, (vy - lag(vy) OVER t) * 10 AS ay, (vxs - lag(vxs) OVER t) * 10 AS axs, (vys - lag(vys) OVER t) * 10 AS ays FROM base WINDOW t AS (PARTITION BY source_file, id ORDER BY frame)),
spread AS (SELECT source_file, stddev_pop(vx) AS vb, stddev_pop(vxs) AS va, stddev_pop(vy) AS wb, stddev_pop(vys) AS wa, stddev_pop(ax) AS ab, stddev_pop(axs) AS aa, stddev_pop(ay) AS bb, stddev_pop(ays) AS ba, count(DISTINCT id) AS vehicles FROM accel GROUP BY source_file),
cutback AS (SELECT *, (vb - va) / vb AS rvx, (wb - wa) / wb AS rvy, (ab - aa) / ab AS rax, (bb - ba) / bb AS ray FROM spread)"""
_PLANTED = """planted AS (SELECT source_file, window_id, split, start_time_sec, end_time_sec FROM kept UNION ALL
  SELECT source_file, window_id, 'val', start_time_sec, end_time_sec FROM kept WHERE split = 'train' AND start_frame % 50 = 0),
spans AS (SELECT DISTINCT source_file, split, start_time_sec AS s, end_time_sec AS e FROM planted),
hits AS (SELECT a.source_file, a.split, count(*) AS intervals, count_if(EXISTS (SELECT 1 FROM spans b WHERE b.source_file = a.source_file AND b.split <> a.split AND b.s < a.e AND b.e > a.s)) AS overlapping FROM spans a GROUP BY ALL),
ids AS (SELECT p.source_file, p.split, count(*) AS shared_ids FROM (SELECT DISTINCT source_file, split, window_id FROM planted) p
  WHERE (SELECT count(DISTINCT q.split) FROM planted q WHERE q.source_file = p.source_file AND q.window_id = p.window_id) > 1 GROUP BY ALL)"""
_SUMMED = lambda c: f"round(sum(round(CAST({c} AS DOUBLE), 3)), 3) + CAST(0 AS DOUBLE)"
_TURNED = """frame_of AS (SELECT window_id, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, CAST(vx AS DOUBLE) / (sqrt(CAST(vx AS DOUBLE) * CAST(vx AS DOUBLE) + CAST(vy AS DOUBLE) * CAST(vy AS DOUBLE)) + CAST(0.000001 AS DOUBLE)) AS c,
  CAST(vy AS DOUBLE) / (sqrt(CAST(vx AS DOUBLE) * CAST(vx AS DOUBLE) + CAST(vy AS DOUBLE) * CAST(vy AS DOUBLE)) + CAST(0.000001 AS DOUBLE)) AS s FROM ego WHERE t = 14),
agents AS (SELECT window_id, 0 AS agent, t, x, y, vx, vy FROM ego WHERE t < 15 UNION ALL SELECT window_id, CAST(list_position(['left_preceding', 'left_alongside', 'left_following', 'right_preceding', 'right_alongside', 'right_following'], slot) AS INTEGER), t, x, y, vx, vy FROM near_hist
  UNION ALL SELECT e.window_id, e.slot_no + 1, CAST(i.t AS BIGINT), CAST(0 AS FLOAT), CAST(0 AS FLOAT), CAST(0 AS FLOAT), CAST(0 AS FLOAT) FROM slots e CROSS JOIN range(15) i(t) WHERE e.mask = 0
  UNION ALL SELECT window_id, -1, t, x, y, NULL, NULL FROM ego WHERE t >= 15),
turned AS (SELECT a.window_id, a.agent, CAST(c * (CAST(x AS DOUBLE) - x0) + s * (CAST(y AS DOUBLE) - y0) AS FLOAT) AS x, CAST(c * (CAST(y AS DOUBLE) - y0) - s * (CAST(x AS DOUBLE) - x0) AS FLOAT) AS y,
  CAST(c * CAST(vx AS DOUBLE) + s * CAST(vy AS DOUBLE) AS FLOAT) AS vx, CAST(c * CAST(vy AS DOUBLE) - s * CAST(vx AS DOUBLE) AS FLOAT) AS vy FROM agents a JOIN frame_of f ON concat(f.window_id, '') = concat(a.window_id, ''))"""
_WIDE = ", ".join(
    f"max(CASE WHEN slot = '{s}' THEN {f} END) AS {s}_{f}" if f in ("mask", "id", "lane", "ttc", "ttc_valid") else f"max(CASE WHEN slot = '{s}' THEN {r(f)} END) AS {s}_{f}"
    for s in ("left_preceding", "left_alongside", "left_following", "right_preceding", "right_alongside", "right_following")
    for f in ("mask", "id", "x", "y", "vx", "vy", "lane", "ttc", "ttc_valid", "thw", "rel_vx", "rel_vy")
)
_INDEX = f"window_id, source_file, dataset_name, vehicle_id, segment_id, start_frame, end_frame, {r('start_time_sec')} AS start_time_sec, {r('end_time_sec')} AS end_time_sec, n_frames_hist, n_frames_fut, source_freq_hz, target_freq_hz"
_LEAD = """leads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY dx, o_id) AS k FROM sided WHERE side IS NULL AND dx > 0) WHERE k = 1),
closing AS (SELECT *, CASE WHEN (evx - ovx) * dir > 0 AND dx / ((evx - ovx) * dir) <= 30 THEN dx / ((evx - ovx) * dir) END AS ttc FROM leads)"""

ORACLES = {
    "canonical_columns": _sql(f"SELECT id, frame, CAST(global_time_ms AS DOUBLE) AS timestamp, {r('x')} AS x, {r('y')} AS y, {r('xVelocity')} AS xVelocity, {r('yVelocity')} AS yVelocity, concat(dataset_name, '_', lpad(regexp_extract(source_file, '[0-9]+'), 2, '0')) AS file_tag FROM tracks WHERE dataset_name = 'corridor_a'", TRACKS),
    "gap_histogram": _sql(f"SELECT source_file, gap, n, CAST(rank AS INTEGER) AS rank, {r('n / samples')} AS share FROM ranked_gaps WHERE rank <= 10", TRACKS, TRACK_STEPS),
    "rate_from_timestamp": _sql(f"""SELECT source_file, mode_gap, {r('confidence')} AS confidence, round_even(1 / (d / 1000), 2) AS detected_freq_hz, {r('1 / round_even(1 / (d / 1000), 2)')} AS dt_seconds, d <= 0 AS bad_times FROM (
  SELECT m.source_file, any_value(m.mode_gap) AS mode_gap, any_value(m.confidence) AS confidence, quantile_cont(s.dt, 0.5) / any_value(m.mode_gap) AS d FROM mode_gap m JOIN stepped s ON s.source_file = m.source_file AND s.gap = m.mode_gap GROUP BY m.source_file)""", TRACKS, TRACK_STEPS),
    "rate_from_timestamp_only": _sql(f"""SELECT source_file, CAST(-1 AS BIGINT) AS mode_gap, {r('n / samples')} AS confidence, round_even(1 / (ms / CAST(1000 AS DOUBLE)), 2) AS detected_freq_hz, {r('ms / CAST(1000 AS DOUBLE)')} AS dt_seconds FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY n DESC, ms) AS k, sum(n) OVER (PARTITION BY source_file) AS samples FROM (SELECT source_file, CAST(round_even(dt, 0) AS BIGINT) AS ms, count(*) AS n FROM stepped WHERE dt IS NOT NULL GROUP BY ALL)) WHERE k = 1""", TRACKS, TRACK_STEPS),
    "rate_from_velocity": _sql(f"SELECT source_file, freq_hz AS detected_freq_hz, {r('residual')} AS residual, {r('greatest(least(1 - residual / greatest(second, CAST(0.00000001 AS DOUBLE)), 1), 0)')} AS confidence, samples, samples < 100 AS too_few FROM ordered WHERE k = 1", TRACKS, TRACK_STEPS, _VELOCITY),
    "rate_report": _sql(f"SELECT source_file, 'velocity_consistency' AS method, freq_hz AS detected_freq_hz, {r('1 - residual / second')} AS confidence, 1 - residual / second < CAST(0.8 AS DOUBLE) AS low_confidence, CASE WHEN abs(freq_hz - 10) < CAST(0.5 AS DOUBLE) THEN CAST(10 AS DOUBLE) WHEN abs(freq_hz - 25) < CAST(0.5 AS DOUBLE) THEN CAST(25 AS DOUBLE) END AS known_freq_hz, mode_gap FROM ordered JOIN mode_gap USING (source_file) WHERE k = 1", TRACKS, TRACK_STEPS, _VELOCITY),
    "track_quality": _sql("SELECT source_file, reason, count(*) AS tracks FROM (SELECT source_file, id, CASE WHEN count(*) < 3 THEN 'too_short' WHEN count(x) < count(*) OR count(y) < count(*) THEN 'not_finite' WHEN min(x) = max(x) OR min(y) = max(y) THEN 'constant' WHEN max(abs(x)) > 1e10 OR max(abs(y)) > 1e10 THEN 'too_far' ELSE 'processed' END AS reason FROM tracks GROUP BY source_file, id) GROUP BY ALL", TRACKS),
    "smooth_positions": _sql(f"SELECT source_file, id, frame, {r('x_smooth')} AS x_smooth, {r('y_smooth')} AS y_smooth FROM smoothed", TRACKS, NUMBERED, SMOOTHED),
    "smoothing_report": _sql("SELECT source_file, vehicles, " + ", ".join(f"{r(a, 4)} AS {b}" for a, b in [("vb", "vx_std_before"), ("va", "vx_std_after"), ("wb", "vy_std_before"), ("wa", "vy_std_after"), ("ab", "ax_std_before"), ("aa", "ax_std_after"), ("bb", "ay_std_before"), ("ba", "ay_std_after"), ("rvx", "vx_reduction"), ("rvy", "vy_reduction"), ("rax", "ax_reduction"), ("ray", "ay_reduction"), ("(rvx + rvy + rax + ray) / 4", "mean_reduction"), ("(rvx + rvy) / 2", "pipeline_reduction")]) + ", CASE WHEN (rvx + rvy + rax + ray) / 4 < CAST(0.05 AS DOUBLE) THEN 'weak' WHEN (rvx + rvy + rax + ray) / 4 > CAST(0.5 AS DOUBLE) THEN 'strong' ELSE 'ok' END AS effect, 5 AS window_length FROM cutback", TRACKS, NUMBERED, SMOOTHED, _SPREADS),
    "downsample": _sql(f"SELECT source_file, id, frame, pos, {r('x_smooth')} AS x_smooth, {r('y_smooth')} AS y_smooth FROM down", TRACKS, NUMBERED, SMOOTHED, DOWN),
    "downsample_report": _sql(f"SELECT source_file, CAST(sum(a) AS BIGINT) AS rows_in, CAST(sum(b) AS BIGINT) AS rows_out, count_if(b < 2) AS short_tracks, {r('sum(b) / sum(a)')} AS keep_ratio FROM (SELECT source_file, id, count(*) AS a, count_if(p % 2 = 0) AS b FROM numbered GROUP BY ALL) GROUP BY source_file", TRACKS, NUMBERED),
    "kinematics": _sql(f"SELECT source_file, id, frame, {r('vx_recomputed')} AS vx_recomputed, {r('vy_recomputed')} AS vy_recomputed, {r('ax_recomputed')} AS xAcceleration, {r('ay_recomputed')} AS yAcceleration FROM kin", *CHAIN[:5]),
    "segments": _sql("SELECT source_file, id, frame, pos, frame_gap, mode_gap, segment_id FROM seg", *CHAIN[:6]),
    "segment_summary": _sql("SELECT source_file, count(*) AS segments, count_if(n < 40) AS short_segments FROM (SELECT source_file, id, segment_id, count(*) AS n FROM seg GROUP BY ALL) GROUP BY source_file", *CHAIN[:6]),
    "window_index": _from_win(f"SELECT {_INDEX} FROM win"),
    "index_summary": _from_win("SELECT dataset_name, source_file, count(*) AS windows, count(DISTINCT vehicle_id) AS vehicle_ids, count(DISTINCT (source_file_of, vehicle_id)) AS vehicles, count(DISTINCT source_file_of) AS files FROM (SELECT *, source_file AS source_file_of FROM win) GROUP BY GROUPING SETS ((dataset_name), (dataset_name, source_file), ())"),
    "direction_groups": _sql("SELECT source_file, CASE WHEN xVelocity >= 0 THEN 1 ELSE -1 END AS vx_sign, count(DISTINCT id) AS vehicles, count(*) AS rows, CASE WHEN quantile_cont(xVelocity, 0.5) >= 0 THEN 1 ELSE -1 END AS direction FROM tracks GROUP BY ALL", TRACKS),
    "neighbor_slots": _from_win(f"SELECT window_id, slot_no, slot, mask, id, {r('x')} AS x, {r('y')} AS y, {r('vx')} AS vx, {r('vy')} AS vy, lane FROM slots", SCENE),
    "slot_risk": _from_win(f"SELECT window_id, slot_no, mask, ttc, ttc_valid, {r('thw')} AS thw, {r('rel_vx')} AS rel_vx, {r('rel_vy')} AS rel_vy FROM slots", SCENE),
    "ttc_own_lane": _from_win(f"SELECT window_id, o_id AS lead_id, {r('dx')} AS gap, {r('ttc')} AS ttc, CASE WHEN ttc IS NULL THEN 0 ELSE 1 END AS ttc_valid, {r('dx / (abs(evx) + CAST(0.000001 AS DOUBLE))')} AS thw FROM closing", SCENE, _LEAD),
    "lane_change": _from_win("SELECT source_file, id, start_frame, is_lane_change FROM lanes", LANES),
    "scene_density": _from_win(f"SELECT window_id, scene_density, {r('evx')} AS ego_vx, {r('evy')} AS ego_vy, e_lane AS ego_lane FROM density JOIN anc USING (window_id)", SCENE, DENSITY),
    "window_features": _from_win(f"SELECT s.window_id, {_WIDE}, any_value(is_lane_change) AS is_lane_change, any_value(scene_density) AS scene_density, any_value({r('evx')}) AS ego_vx_at_hist_end, any_value({r('evy')}) AS ego_vy_at_hist_end, any_value(e_lane) AS \"ego_laneId_at_hist_end\" FROM slots s JOIN anc USING (window_id) JOIN density USING (window_id) JOIN (SELECT window_id, is_lane_change FROM lanes) l ON l.window_id = s.window_id GROUP BY s.window_id", SCENE, DENSITY, LANES),
    "feature_summary": _from_win(f"SELECT w.source_file, count(*) AS windows, CAST(sum(is_lane_change) AS BIGINT) AS lane_changes, {r('avg(scene_density)')} AS mean_density, " + ", ".join(f"CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM best b WHERE b.window_id = w.window_id AND b.slot = '{s}') THEN 1 ELSE 0 END) AS BIGINT) AS {s}_windows" for s in ("left_preceding", "left_alongside", "left_following", "right_preceding", "right_alongside", "right_following")) + " FROM win w JOIN density USING (window_id) JOIN lanes l ON l.window_id = w.window_id GROUP BY w.source_file", SCENE, DENSITY, LANES),
    "resume_windows": _from_win("SELECT window_id, source_file, start_frame FROM win WHERE vehicle_id % 2 = 1"),
    "time_split": _from_win("SELECT window_id, source_file, split FROM kept", SPLIT),
    "split_summary": _from_win(f"""SELECT dataset_name, source_file, count(*) AS windows, count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test, count_if(split <> 'gap') AS kept, count_if(split = 'gap') AS dead_zone,
  {r("count_if(split = 'train') / count_if(split <> 'gap')")} AS train_share, {r("count_if(split = 'val') / count_if(split <> 'gap')")} AS val_share, {r("count_if(split = 'test') / count_if(split <> 'gap')")} AS test_share FROM zoned GROUP BY ROLLUP (dataset_name, source_file)""", SPLIT),
    "split_overlap": _from_win("SELECT h.source_file, h.split, intervals, overlapping, coalesce(shared_ids, 0) AS shared_ids FROM hits h LEFT JOIN ids i ON i.source_file = h.source_file AND i.split = h.split", SPLIT, _PLANTED),
    "ego_arrays": _from_win("SELECT window_id, t, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CASE WHEN t < 15 THEN CAST(vx AS DOUBLE) END AS vx, CASE WHEN t < 15 THEN CAST(vy AS DOUBLE) END AS vy FROM ego".replace("CAST(x AS DOUBLE)", r("CAST(x AS DOUBLE)", 3)).replace("CAST(y AS DOUBLE)", r("CAST(y AS DOUBLE)", 3)).replace("CAST(vx AS DOUBLE)", r("CAST(vx AS DOUBLE)", 3)).replace("CAST(vy AS DOUBLE)", r("CAST(vy AS DOUBLE)", 3)), SCENE, STATES),
    "neighbor_history": _from_win(f"SELECT window_id, slot_no, t, {r('CAST(x AS DOUBLE)', 3)} AS x, {r('CAST(y AS DOUBLE)', 3)} AS y, {r('CAST(vx AS DOUBLE)', 3)} AS vx, {r('CAST(vy AS DOUBLE)', 3)} AS vy FROM near_hist JOIN slot_names USING (slot)", SCENE, STATES),
    "interaction_features": _from_win(f"SELECT window_id, slot_no, CAST(0 AS DOUBLE) AS ttc, {r('CAST(CAST(coalesce(thw, 0) AS FLOAT) AS DOUBLE)', 4)} AS thw, {r('CAST(CAST(coalesce(rel_vx, 0) AS FLOAT) AS DOUBLE)', 4)} AS rel_vx, {r('CAST(CAST(coalesce(rel_vy, 0) AS FLOAT) AS DOUBLE)', 4)} AS rel_vy, CAST(0 AS DOUBLE) AS ttc_valid, CAST(1 AS DOUBLE) AS mask FROM slots WHERE mask = 1", SCENE),
    "normalized_samples": _from_win(f"SELECT window_id, agent, {_SUMMED('x')} AS x, {_SUMMED('y')} AS y, {_SUMMED('vx')} AS vx, {_SUMMED('vy')} AS vy FROM turned GROUP BY window_id, agent", SCENE, STATES, _TURNED),
    "sink_round_trip": _from_win("SELECT split, count(*) AS windows, CAST(sum(start_frame) AS BIGINT) AS start_frames FROM kept GROUP BY split", SPLIT),
    "input_quarantine": _sql("SELECT source_file, count(*) AS good_rows, count_if(frame % 100 = 0) AS bad_rows FROM tracks GROUP BY source_file", TRACKS),
}

_F4 = lambda c: r(f"CAST(CAST(coalesce({c}, 0) AS FLOAT) AS DOUBLE)", 4)
ORACLES["sample_rows"] = _from_win(f"""SELECT k.window_id, k.split, l.is_lane_change = 1 AS is_lane_change, CAST(d.scene_density AS BIGINT) AS scene_density, CAST(10 AS DOUBLE) AS source_freq, CAST(s.slot_no AS BIGINT) AS slot_no,
  CAST(s.mask AS DOUBLE) AS mask, CAST(0 AS DOUBLE) AS valid_ttc, true AS constant, CAST(0 AS DOUBLE) AS ttc, {_F4('thw')} AS thw, {_F4('rel_vx')} AS rel_vx, {_F4('rel_vy')} AS rel_vy, CAST(0 AS DOUBLE) AS f_valid, CAST(s.mask AS DOUBLE) AS f_mask
  FROM kept k JOIN slots s USING (window_id) JOIN density d USING (window_id) JOIN lanes l USING (window_id)""", SCENE, DENSITY, LANES, SPLIT)
_CLOCK = """clocked AS (SELECT w.* EXCLUDE (start_time_sec, end_time_sec), s.frame AS anchor_frame, CAST(s.frame AS DOUBLE) / 10 AS anchor_time_sec, CAST(s.frame AS DOUBLE) / 10 - CAST(14 AS DOUBLE) / 5 AS start_time_sec,
  CAST(s.frame AS DOUBLE) / 10 - CAST(14 AS DOUBLE) / 5 + (w.end_time_sec - w.start_time_sec) AS end_time_sec FROM win w JOIN seg s ON s.source_file = w.source_file AND s.id = w.vehicle_id AND s.pos = w.start_frame + 14)"""
ORACLES["split_by_recording"] = _from_win(f"SELECT window_id, source_file, anchor_frame, {r('anchor_time_sec')} AS anchor_time_sec, split FROM kept", _CLOCK, SPLIT.replace("FROM win", "FROM clocked"))
ORACLES["window_quality"] = _from_win("SELECT source_file, count(*) AS windows, count_if(evx IS NULL) AS without_velocity, count_if(sqrt(evx * evx + evy * evy) < CAST(0.001 AS DOUBLE)) AS standing FROM anc GROUP BY source_file", SCENE)
ORACLES["pipeline_info"] = _sql(f"""SELECT source_file, CAST(10 AS DOUBLE) AS source_freq_hz, CAST(5 AS DOUBLE) AS target_freq_hz, 2 AS step, 5 AS window_length, {r('rvx', 4)} AS vx_reduction, {r('rvy', 4)} AS vy_reduction,
  {r('(1 - va / vb + 1 - wa / wb) / 2', 4)} AS pipeline_reduction, CASE WHEN (rvx + rvy + rax + ray) / 4 < CAST(0.05 AS DOUBLE) THEN 'weak' WHEN (rvx + rvy + rax + ray) / 4 > CAST(0.5 AS DOUBLE) THEN 'strong' ELSE 'ok' END AS effect FROM cutback""", TRACKS, NUMBERED, SMOOTHED, _SPREADS)
ORACLES["track_sink"] = _sql(f"SELECT dataset_name, source_file, count(*) AS rows, CAST(sum(pos) AS BIGINT) AS places, CAST(sum(segment_id) AS BIGINT) AS segments, {r('round(sum(round(x_smooth, 6)), 3)', 3)} AS x, {r('round(sum(round(ay_recomputed, 6)), 3)', 3)} AS ay FROM seg GROUP BY ALL", *CHAIN[:6])
ORACLES["index_sink"] = _from_win("SELECT window_id, source_file, start_frame, end_frame, dataset_name FROM win WHERE dataset_name = 'corridor_a'")
ORACLES["feature_sink"] = ORACLES["window_features"]
ORACLES["resumed_features"] = _from_win("""SELECT w.window_id, l.is_lane_change, d.scene_density, CASE WHEN EXISTS (SELECT 1 FROM best b WHERE b.window_id = w.window_id AND b.slot = 'left_preceding') THEN 1 ELSE 0 END AS left_preceding_mask,
  (SELECT o_id FROM best b WHERE b.window_id = w.window_id AND b.slot = 'right_following') AS right_following_id FROM win w JOIN lanes l USING (window_id) JOIN density d USING (window_id) WHERE w.vehicle_id % 2 = 1""", SCENE, DENSITY, LANES)
_FORM = "CAST(regexp_extract(source_file, '[0-9]+') AS INTEGER) % 3"
ORACLES["raw_recordings"] = _sql(f"""SELECT source_file, id, frame, CASE WHEN {_FORM} = 1 THEN CAST(global_time_ms AS DOUBLE) END AS timestamp, CASE WHEN {_FORM} = 1 THEN {r('xVelocity')} END AS speed,
  {r(f'CASE WHEN {_FORM} = 1 THEN vx_recomputed ELSE xVelocity END')} AS xVelocity, {r(f'CASE WHEN {_FORM} = 1 THEN vy_recomputed ELSE yVelocity END')} AS yVelocity, CASE WHEN {_FORM} <> 1 THEN laneId END AS laneId, pos, segment_id, CAST(10 AS DOUBLE) AS source_freq_hz FROM seg""", *CHAIN[:6])
ORACLES["detected_recordings"] = _from_win("SELECT source_file, CAST(10 AS DOUBLE) AS source_freq_hz, count(*) AS windows, CAST(sum(start_frame) AS BIGINT) AS starts FROM win GROUP BY source_file")
ORACLES["recording_report"] = _sql("""SELECT source_file, 'partial' AS status, count(*) AS good_rows, count_if(frame % 100 = 0) + count_if(frame % 150 = 0) AS bad_rows, count_if(frame % 100 = 0) AS bad_x, count_if(frame % 150 = 0) AS bad_fields FROM tracks GROUP BY source_file
  UNION ALL SELECT 'rec_lost', 'missing', 0, 0, 0, 0""", TRACKS)

#: Evidence by recording, in turn: all, velocities, speeds, neither, times alone.
_KIND = "CAST(regexp_extract(source_file, '[0-9]+') AS INTEGER) % 5"
_EVIDENCE = f"""spoken AS (SELECT *, {_KIND} AS kind, sqrt(xVelocity * xVelocity + yVelocity * yVelocity) AS pace FROM tracks),
paced AS (SELECT source_file, kind, frame - lag(frame) OVER t AS gap, x - lag(x) OVER t AS dx, CASE kind WHEN 2 THEN (pace + lag(pace) OVER t) / 2 ELSE (xVelocity + lag(xVelocity) OVER t) / 2 END AS v FROM spoken WINDOW t AS ({BY} ORDER BY frame)),
tried2 AS (SELECT s.source_file, f.freq_hz, s.dx * f.freq_hz / m.mode_gap / s.v AS ratio FROM paced s JOIN mode_gap m ON m.source_file = s.source_file AND m.mode_gap = s.gap
  CROSS JOIN (SELECT CAST(unnest([10, 25, 30, 50]) AS DOUBLE) AS freq_hz) f WHERE abs(s.v) > 1 AND s.kind IN (1, 2)),
fits2 AS (SELECT source_file, freq_hz, quantile_cont(abs(ln(abs(ratio) + CAST(0.00000001 AS DOUBLE))), 0.5) AS residual FROM tried2 GROUP BY ALL),
by_v AS (SELECT a.source_file, a.freq_hz AS hz, 1 - a.residual / min(b.residual) AS sure FROM fits2 a JOIN fits2 b ON b.source_file = a.source_file AND b.freq_hz <> a.freq_hz GROUP BY a.source_file, a.freq_hz, a.residual HAVING a.residual <= min(b.residual)),
by_t AS (SELECT s.source_file, round_even(1 / (quantile_cont(s.dt, 0.5) / any_value(m.mode_gap) / 1000), 2) AS hz, any_value(m.confidence) AS sure FROM stepped s JOIN mode_gap m ON m.source_file = s.source_file AND m.mode_gap = s.gap GROUP BY s.source_file),
by_ms AS (SELECT source_file, round_even(1 / (dt / 1000), 2) AS hz, n / total AS sure FROM (SELECT source_file, dt, count(*) AS n, sum(count(*)) OVER (PARTITION BY source_file) AS total, row_number() OVER (PARTITION BY source_file ORDER BY count(*) DESC, dt) AS k FROM stepped WHERE dt IS NOT NULL GROUP BY source_file, dt) WHERE k = 1),
told AS (SELECT m.source_file, m.kind, CASE m.kind WHEN 0 THEN t.hz WHEN 4 THEN ms.hz WHEN 3 THEN NULL ELSE v.hz END AS hz, CASE m.kind WHEN 0 THEN t.sure WHEN 4 THEN ms.sure WHEN 3 THEN m.confidence ELSE v.sure END AS sure, m.mode_gap
  FROM (SELECT *, {_KIND} AS kind FROM mode_gap) m LEFT JOIN by_t t USING (source_file) LEFT JOIN by_ms ms USING (source_file) LEFT JOIN by_v v USING (source_file))"""
_KNOWN = "CASE WHEN abs(hz - 10) < CAST(0.5 AS DOUBLE) THEN CAST(10 AS DOUBLE) WHEN abs(hz - 25) < CAST(0.5 AS DOUBLE) THEN CAST(25 AS DOUBLE) END"
ORACLES["rate_evidence"] = _sql(f"""SELECT source_file, CASE WHEN kind IN (0, 4) THEN 'timestamp_column' WHEN kind = 3 THEN 'frame_column' ELSE 'velocity_consistency' END AS method, hz AS detected_freq_hz, {r('sure')} AS confidence,
  hz IS NULL OR sure < CAST(0.8 AS DOUBLE) AS low_confidence, {_KNOWN} AS known_freq_hz, CASE WHEN kind = 4 THEN CAST(-1 AS BIGINT) ELSE mode_gap END AS mode_gap FROM told""", TRACKS, TRACK_STEPS, _EVIDENCE)
ORACLES["rate_report_of_sample"] = _sql("SELECT source_file, freq_hz AS detected_freq_hz, 1 - residual / second < CAST(0.8 AS DOUBLE) AS low_confidence, mode_gap, (SELECT least(3, count(DISTINCT t.id)) FROM tracks t WHERE t.source_file = ordered.source_file) AS vehicles FROM ordered JOIN mode_gap USING (source_file) WHERE k = 1", TRACKS, TRACK_STEPS, _VELOCITY)
#: A least-squares parabola by orthogonal polynomials 1, s, s^2 - s2 / m over the places s = -h .. h of m rows.
_AT_RATES = f"""given AS (SELECT *, [10, 25, 30, 50][CAST(regexp_extract(source_file, '[0-9]+') AS INTEGER) % 4 + 1] AS hz FROM tracks),
numbered AS (SELECT *, row_number() OVER ({BY} ORDER BY frame) - 1 AS p, count(*) OVER ({BY}) AS n, CASE hz WHEN 10 THEN 5 WHEN 50 THEN 15 ELSE 9 END AS m, CAST(hz / 5 AS INTEGER) AS step FROM given),
cut AS (SELECT *, least(greatest(p, m // 2), n - 1 - m // 2) AS c FROM numbered WHERE p % step = 0),
sums AS (SELECT m, CAST(sum(s * s) AS DOUBLE) AS s2, CAST(sum(s * s * s * s) AS DOUBLE) AS s4 FROM (SELECT m, unnest(range(-(m // 2), m // 2 + 1)) AS s FROM (VALUES (5), (9), (15)) v(m)) GROUP BY m),
fitted AS (SELECT a.source_file, a.id, a.frame, sum(b.x * w) AS x_smooth, sum(b.y * w) AS y_smooth FROM (
  SELECT a.source_file, a.id, a.frame, a.c + i.s AS at, 1 / CAST(a.m AS DOUBLE) + (a.p - a.c) * i.s / q.s2 + ((a.p - a.c) * (a.p - a.c) - q.s2 / a.m) * (i.s * i.s - q.s2 / a.m) / (q.s4 - q.s2 * q.s2 / a.m) AS w
  FROM cut a JOIN sums q ON q.m = a.m JOIN range(-7, 8) i(s) ON abs(i.s) <= a.m // 2) a
  JOIN numbered b ON b.source_file = a.source_file AND b.id = a.id AND b.p = a.at GROUP BY ALL),
down AS (SELECT c.* EXCLUDE (p, n, m, c), CAST(c.p // c.step AS BIGINT) AS pos, f.x_smooth, f.y_smooth FROM cut c JOIN fitted f USING (source_file, id, frame))"""
ORACLES["many_rates"] = _sql(f"SELECT source_file, id, frame, pos, {r('x_smooth')} AS x_smooth, {r('y_smooth')} AS y_smooth, {r('vx_recomputed')} AS vx_recomputed, {r('ax_recomputed')} AS xAcceleration, segment_id, CAST(hz AS DOUBLE) AS source_freq_hz FROM seg", TRACKS, _AT_RATES, KIN, SEG)
ORACLES["unfit_recordings"] = _sql("""SELECT source_file, CAST([10, 7, 1000, NULL, 25][k + 1] AS DOUBLE) AS source_freq_hz, CAST([2, NULL, NULL, NULL, 5][k + 1] AS INTEGER) AS step, CAST([5, NULL, NULL, NULL, 9][k + 1] AS INTEGER) AS length,
  [NULL, 'no_whole_step', 'window_too_long', 'no_rate', NULL][k + 1] AS problem FROM (SELECT DISTINCT source_file, CAST(regexp_extract(source_file, '[0-9]+') AS INTEGER) % 5 AS k FROM tracks)""", TRACKS)
_PLANTED_CLOCK = _PLANTED.replace("'val', start_time_sec, end_time_sec FROM kept WHERE split = 'train' AND start_frame % 50 = 0", "'train', start_time_sec, end_time_sec FROM kept WHERE split = 'test' AND anchor_frame % 40 = 0")
ORACLES["split_overlap_by_recording"] = _from_win("SELECT h.source_file, h.split, intervals, overlapping, coalesce(shared_ids, 0) AS shared_ids FROM hits h LEFT JOIN ids i ON i.source_file = h.source_file AND i.split = h.split", _CLOCK, SPLIT.replace("FROM win", "FROM clocked"), _PLANTED_CLOCK)
_FAMILIES = """given AS (SELECT concat('rec_', s_suppkey) AS prefix, concat('site_', s_nationkey) AS dataset_name, CAST(s_suppkey % 5 * 5 + 5 AS DOUBLE) AS source_freq_hz FROM supplier UNION ALL SELECT 'rec', 'other', CAST(10 AS DOUBLE)),
counted AS (SELECT source_file, count(*) + count_if(frame % 100 = 0) + count_if(frame % 150 = 0) AS rows FROM tracks GROUP BY source_file),
matched AS (SELECT c.source_file, c.rows, g.dataset_name, g.source_freq_hz, row_number() OVER (PARTITION BY c.source_file ORDER BY length(g.prefix) DESC) AS k FROM counted c JOIN given g ON starts_with(c.source_file, g.prefix))"""
ORACLES["tagged_recordings"] = _sql("SELECT source_file, dataset_name, source_freq_hz, rows FROM matched WHERE k = 1", TRACKS, _FAMILIES)
ORACLES["merged_summary"] = _from_win("""SELECT dataset_name, source_file, CAST(sum(n) AS BIGINT) AS windows, CAST(count(*) AS BIGINT) AS vehicles, count(DISTINCT file) AS files, true AS ids_near
  FROM (SELECT dataset_name, source_file, source_file AS file, vehicle_id, count(*) AS n FROM win GROUP BY ALL) GROUP BY GROUPING SETS ((dataset_name), (dataset_name, source_file), ())""")
ORACLES["recording_manifest"] = _from_win("""SELECT s.source_file, CASE WHEN k IN (1, 2) THEN 'failed' ELSE 'ok' END AS first_status, CASE k WHEN 1 THEN 'no_rate' WHEN 2 THEN 'torn' END AS first_reason, 'ok' AS status, CAST(CASE WHEN k IN (1, 2) THEN 2 ELSE 1 END AS INTEGER) AS attempt, n AS tracks,
  coalesce(w.windows, 0) AS windows, n AS stored FROM (SELECT source_file, CAST(regexp_extract(source_file, '[0-9]+') AS INTEGER) % 5 AS k, count(*) AS n FROM seg GROUP BY ALL) s LEFT JOIN (SELECT source_file, count(*) AS windows FROM win GROUP BY ALL) w USING (source_file)""")
ORACLES["stored_features"], ORACLES["stored_histories"] = ORACLES["window_features"], ORACLES["ego_arrays"]
