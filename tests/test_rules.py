"""Edge rules on hand-made rows, and properties that hold for any track."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import savgol
from roadloom.operators import features, frequency, neighbors, resample, samples, smoothing, splits, windows
from roadloom.operators.medians import exact_medians
from roadloom.plans import resumable
from roadloom.plans.workloads import features_to_samples, processed_recordings, processed_tracks, recording_rates, split_windows, tracks_to_windows
from roadloom.sources import recordings
from roadloom.sources.canonical import canonical
from roadloom.streaming.recordings import process_new

TRACK = "dataset_name string, source_file string, id long, frame long, x double, y double, xVelocity double, yVelocity double, laneId long"


def track(vid, n, x=lambda p: 20.0 * p, y=lambda p: 0.1 * p, frame=lambda p: p, lane=1, vx=20.0, file="rec"):
    return [("d", file, vid, frame(p), float(x(p)), float(y(p)), vx, 0.0, lane) for p in range(n)]


def test_window_lengths():
    assert [savgol.window_length(hz) for hz in (10, 25, 30, 50)] == [5, 9, 9, 15]
    with pytest.raises(ValueError):
        savgol.window_length(0)
    with pytest.raises(ValueError):
        savgol.checked_length(4, 2)
    assert np.allclose(savgol.weights(5) * 35, [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]])


def test_smoothing_keeps_quadratics_and_matches_polyfit(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(size=40)
    rows = track(1, 30, lambda p: 3 + 2 * p + 0.5 * p * p, lambda p: p * p) + track(2, 40, lambda p: 20 * p + noise[p], lambda p: noise[p])
    got = smoothing.smooth_positions(spark.createDataFrame(rows, TRACK), 25.0).orderBy("id", "frame").collect()
    assert all(abs(r.x - r.x_smooth) < 1e-9 and abs(r.y - r.y_smooth) < 1e-9 for r in got if r.id == 1)
    x = 20 * np.arange(40) + noise
    want = [np.polyval(np.polyfit(np.arange(c - 4, c + 5), x[c - 4 : c + 5], 2), p) for p in range(40) for c in [min(max(p, 4), 35)]]
    assert np.allclose([r.x_smooth for r in got if r.id == 2], want)


def test_short_and_unsafe_tracks_stay_raw(spark):
    bump = lambda p: (p % 3) * 1.0 + p
    rows = track(1, 2, bump) + track(2, 4, bump) + track(3, 6, bump) + track(4, 9, lambda p: 5.0) + track(5, 9, lambda p: 1e11 + p) + [(*r[:4], None, *r[5:]) if r[3] == 4 else r for r in track(6, 9, bump)] + track(7, 9, bump)
    df = spark.createDataFrame(rows, TRACK)
    changed = {r.id for r in smoothing.smooth_positions(df, 10.0).collect() if r.x is not None and abs(r.x - r.x_smooth) > 1e-6}
    assert changed == {3, 7}
    quality = {r.reason: r.tracks for r in smoothing.track_quality(df).collect()}
    assert quality == {"too_short": 1, "processed": 3, "constant": 1, "too_far": 1, "not_finite": 1}


def test_thinning_and_gradients(spark):
    for bad in (3.0, 20.0):
        with pytest.raises(ValueError):
            resample.step_of(10.0, bad)
    df = spark.createDataFrame(track(1, 9) + track(2, 1) + track(3, 3), TRACK)
    with pytest.raises(ValueError):
        resample.downsample(df, 10.0)
    thin = resample.downsample(smoothing.smooth_positions(df, 10.0), 10.0)
    assert {(r.id, r.frame, r.pos) for r in thin.collect()} == {(1, 2 * p, p) for p in range(5)} | {(2, 0, 0), (3, 0, 0), (3, 2, 1)}
    kin = {(r.id, r.pos): r for r in resample.kinematics(thin).collect()}
    assert all(abs(kin[1, p].vx_recomputed - 200) < 1e-9 and abs(kin[1, p].ax_recomputed) < 1e-9 for p in range(5))
    assert kin[2, 0].vx_recomputed == 0 and abs(kin[3, 0].vx_recomputed - 200) < 1e-9 and kin[3, 1].ax_recomputed == 0
    made = resample.standardised(resample.kinematics(thin).drop("xVelocity"))
    assert all(r.xVelocity == r.vx_recomputed and r.yVelocity == r.vy_recomputed for r in made.collect())


@pytest.mark.parametrize("n,count", [(39, 0), (40, 1), (44, 1), (45, 2)])
def test_only_complete_windows(spark, n, count):
    df = spark.createDataFrame(track(1, n), TRACK).withColumn("pos", F.col("frame")).withColumn("y_smooth", F.col("y"))
    assert windows.window_index(windows.segments(df), 10.0).count() == count


def test_windows_do_not_span_gaps_and_ids_are_unique(spark):
    df = spark.createDataFrame(track(1, 100, frame=lambda p: p + (7 if p >= 50 else 0)), TRACK).withColumn("pos", F.row_number().over(windows.in_order()) - 1)
    index = windows.window_index(windows.segments(df), 10.0).orderBy("start_frame").collect()
    assert [(r.segment_id, r.start_frame) for r in index] == [(0, 0), (0, 5), (0, 10), (1, 50), (1, 55), (1, 60)]
    assert len({r.window_id for r in index}) == 6
    with pytest.raises(ValueError):
        windows.frames(0.3, 5)


def test_slots_at_their_borders_and_ties(spark):
    at = [(2, 25.0, -1.8), (3, 25.0, -1.9), (4, 25.0, -1.9), (5, 20.0 + 5, 3.0), (6, 20.0 + 5.1, 3.0), (7, 20.0 - 5.1, 3.0), (8, 30.0, 0.0)]
    rows = [("d", "rec", 1, 14, 20.0, 0.0, 10.0, 0.0, 1)] + [("d", "rec", i, 14, x, y, 5.0, 0.0, 1) for i, x, y in at] + [("d", "rec", 9, 14, 21.0, -3.0, -20.0, 0.0, 1)]
    df = spark.createDataFrame(rows, TRACK).withColumn("pos", F.lit(14).cast("long"))
    index = spark.createDataFrame([("w", "rec", 1, 0, 15)], "window_id string, source_file string, vehicle_id long, start_frame long, n_frames_hist int")
    r = neighbors.surroundings(index, df).first()
    assert r.left_alongside.id == 3 and r.right_alongside.id == 5 and r.right_preceding.id == 6 and r.right_following.id == 7
    assert r.left_preceding is None and r.scene_density == 7 and r.own_lead.id == 2
    risk = neighbors.own_lane_risk(neighbors.surroundings(index, df)).first()
    assert risk.ttc == 1.0 and risk.gap == 5.0


def test_time_to_collision_limit(spark):
    from roadloom.functions.tracks import time_to_collision

    df = spark.createDataFrame([(30.0, 1.0), (30.1, 1.0), (-30.0, -1.0), (5.0, -1.0), (0.0, 1.0)], "dx double, v double")
    assert [r[0] for r in df.select(time_to_collision(F.col("dx"), F.col("v"))).collect()] == [30.0, None, 30.0, None, None]


def test_mirrored_direction_and_missing_velocity(spark):
    rows = [("d", "rec", 1, 14, 0.0, 0.0, -10.0, 0.0, 1), ("d", "rec", 2, 14, -20.0, 3.0, -9.0, 0.0, 1), ("d", "rec", 3, 14, 0.0, 0.0, None, 0.0, 1)]
    df = spark.createDataFrame(rows, TRACK).withColumn("pos", F.lit(14).cast("long"))
    index = spark.createDataFrame([("a", "rec", 1, 0, 15), ("b", "rec", 3, 0, 15)], "window_id string, source_file string, vehicle_id long, start_frame long, n_frames_hist int")
    got = {r.window_id: r for r in neighbors.surroundings(index, df).collect()}
    assert got["a"].left_preceding.id == 2 and got["b"].scene_density == 0 and got["b"].left_preceding is None


def test_split_rules_and_overlap(spark):
    rows = [(f"w{i}", "d", "rec", float(i), float(i) + 7.8) for i in range(200)]
    index = spark.createDataFrame(rows, "window_id string, dataset_name string, source_file string, start_time_sec double, end_time_sec double")
    kept = splits.time_split(index)
    splits.assert_no_overlap(kept)
    counts = {r.split: r["count"] for r in kept.groupBy("split").count().collect()}
    assert set(counts) == {"train", "val", "test"} and sum(counts.values()) < 200
    planted = kept.unionByName(kept.where("split = 'train'").limit(1).withColumn("split", F.lit("test")))
    with pytest.raises(ValueError):
        splits.assert_no_overlap(planted)
    alone = index.limit(1).withColumn("end_time_sec", F.col("start_time_sec"))
    assert splits.time_split(alone).first().split == "train"


def test_overlap_is_checked_on_the_clock_that_split(spark):
    # Vehicles enter one after the other, so that a window's time in its track says little about the recording's clock.
    rows = [(f"w{v}_{i}", "d", "rec", float(i), i + 7.8, 15, 5.0, 60.0 * v + i + 2.8) for v in range(12) for i in range(50)]
    index = spark.createDataFrame(rows, "window_id string, dataset_name string, source_file string, start_time_sec double, end_time_sec double, n_frames_hist int, target_freq_hz double, anchor_time_sec double")
    kept = split_windows(index, time_basis="recording")
    assert {r.split for r in kept.select("split").distinct().collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError):  # on the tracks' own clock the same windows overlap
        splits.assert_no_overlap(kept.drop(*splits.CLOCK))
    leak = kept.where("split = 'test'").orderBy("window_id").limit(1).withColumns({"split": F.lit("train"), "window_id": F.lit("other")})
    with pytest.raises(ValueError):
        splits.assert_no_overlap(kept.unionByName(leak))
    far = leak.withColumns({splits.CLOCK[0]: F.lit(9000.0), splits.CLOCK[1]: F.lit(9007.8)})
    splits.assert_no_overlap(kept.unionByName(far))


def test_slabs_find_what_one_sweep_finds(spark):
    rng = np.random.default_rng(5)
    rows = [("rec", f"w{i}", ("train", "val", "test")[rng.integers(3)], float(s), float(s + d)) for i, (s, d) in enumerate(zip(rng.integers(0, 3000, 300), rng.choice([1, 3, 40, 900], 300, p=[0.5, 0.3, 0.19, 0.01])))]
    df = spark.createDataFrame(rows, "source_file string, window_id string, split string, start_time_sec double, end_time_sec double")
    spans = {(r[2], r[3], r[4]) for r in rows}
    want = {x: sum(any(b[0] != x and b[1] < a[2] and b[2] > a[1] for b in spans) for a in spans if a[0] == x) for x in splits.SPLITS}
    for slab in (1.0, 50.0, 1e9):
        assert {r.split: r.overlapping for r in splits.split_overlap(df, slab).collect()} == want


def test_medians_of_any_size(spark):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=5001), "b": np.exp(rng.normal(size=4000) * 40), "c": rng.choice([1.0, 2.0, 1e9], 3000), "d": np.array([3.0]), "e": np.repeat([1.0, 2.0], 1500), "f": np.full(2500, 7.0), "g": -np.arange(2000.0) ** 3}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("h", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for few, cells in ((10, 4), (100, 64), (10_000, 256)):
        got = {r.k: (r.n, r.median) for r in exact_medians(df, ["k"], "v", few, cells).collect()}
        assert got == {k: (len(x), float(np.median(x))) for k, x in groups.items()}


def test_rates_by_each_recordings_own_evidence(spark):
    kinds = {"all": (1, 1, 1, 0), "moving": (1, 0, 1, 0), "speed": (1, 0, 0, 1), "none": (1, 0, 0, 0), "times": (0, 1, 0, 0), "back": (1, -1, 1, 0)}
    rows = [(f, v, p if k[0] else None, 2.0 * p + v, 20.0 if k[2] else None, 20.0 if k[3] else None, k[1] * (1000.0 + 100 * p) if k[1] else None) for f, k in kinds.items() for v in (1, 2) for p in range(80)]
    df = spark.createDataFrame(rows, "source_file string, id long, frame long, x double, xVelocity double, speed double, timestamp double")
    got = {r.source_file: (r.method, r.detected_freq_hz, r.low_confidence) for r in frequency.rate_report(df).collect()}
    times, moving = ("timestamp_column", 10.0, False), ("velocity_consistency", 10.0, False)
    assert got == {"all": times, "times": times, "moving": moving, "speed": moving, "none": ("frame_column", None, True), "back": ("timestamp_column", None, True)}


def test_one_scan_and_one_shuffle_for_all_rates(spark, tmp_path):
    hz = {"a": 10.0, "b": 25.0, "c": 50.0, "d": 7.0, "e": 30.0}
    spark.createDataFrame([r for f in hz for r in track(1, 90, lambda p: p + (p % 3) * 0.5, file=f) + track(2, 4, file=f) + track(3, 2, file=f)], TRACK).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rates = spark.createDataFrame(list(hz.items()), "source_file string, source_freq_hz double")
    plan = recording_rates(df, rates)
    assert {(r.source_file, r.step, r.length, r.problem) for r in plan.collect()} == {("a", 2, 5, None), ("b", 5, 9, None), ("c", 10, 15, None), ("d", None, None, "no_whole_step"), ("e", 6, 9, None)}
    made = processed_recordings(df, plan=plan)
    text = made._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(source_file") == 1 and text.count("Exchange hashpartitioning") == 1 and text.count(str(tmp_path)) == 1
    for f, rate in hz.items():
        if f != "d":
            alone = processed_tracks(df.where(F.col("source_file") == f), rate)
            columns = ("id", "frame", "pos", "segment_id", "x_smooth", "y_smooth", "vx_recomputed", "xAcceleration")
            a, b = (np.array(sorted(map(tuple, t.select(*columns).collect()))) for t in (alone, made.where(F.col("source_file") == f)))
            assert a.shape == b.shape and np.allclose(a, b)


def test_headers_are_read_by_position(spark, tmp_path):
    import gzip

    (tmp_path / "long.csv").write_text("id,frame," + ",".join(f"c{i}" for i in range(400)) + "\r\n1,2\r\n")
    (tmp_path / "bare.csv").write_text("id,frame")
    (tmp_path / "empty.csv").write_text("")
    with gzip.open(tmp_path / "zipped.csv.gz", "wt") as f:
        f.write("frame,id\n1,2\n")
    got = {r.file.rsplit("/", 1)[-1]: r.header for r in recordings.headers(spark, [str(tmp_path)], head=64).collect()}
    assert got == {r.file.rsplit("/", 1)[-1]: r.header for r in recordings._headers_by_lines(spark, [str(tmp_path)]).collect()}
    assert set(got) == {"long.csv", "bare.csv", "zipped.csv.gz"} and got["long.csv"].endswith("c399") and got["zipped.csv.gz"] == "frame,id"


def test_rates_by_each_way(spark):
    rows = [("rec", v, p, 2.0 * p + v, 20.0, 1000.0 + 100 * p) for v in (1, 2) for p in range(80)]
    df = spark.createDataFrame(rows, "source_file string, id long, frame long, x double, xVelocity double, timestamp double")
    assert frequency.rate_report(df).first().detected_freq_hz == 10.0
    assert frequency.rate_report(df.drop("frame")).first().detected_freq_hz == 10.0
    assert frequency.rate_report(df.drop("timestamp")).first().detected_freq_hz == 10.0
    assert frequency.rate_report(df.drop("timestamp", "x")).first().detected_freq_hz is None
    assert frequency.sampled(df, 1).select("id").distinct().count() == 1
    assert frequency.mode_gaps(df).first().gap_distribution == {1: 158}
    back = df.withColumn("timestamp", -F.col("timestamp"))
    flags = [(r.detected_freq_hz, r.bad_times) for d in (df, back, df.withColumn("timestamp", F.lit(None).cast("double"))) for r in frequency.rate_from_timestamp(d).collect()]
    assert flags == [(10.0, False), (None, True), (None, False)]


def test_counts_by_sketches_are_near(spark):
    index = spark.createDataFrame([("d", f"rec_{i % 3}", i % 50, i) for i in range(900)], "dataset_name string, source_file string, vehicle_id long, start_frame long")
    exact, near = ({(r.dataset_name, r.source_file): r for r in windows.index_summary(index, a).collect()} for a in (False, True))
    assert set(exact) == set(near) and len(exact) == 5
    assert all(abs(near[k].vehicles - r.vehicles) <= 0.2 * r.vehicles and near[k].windows == r.windows for k, r in exact.items())


def test_canonical_names(spark):
    df = spark.createDataFrame([(1, 2, float("nan"), 3.0)], "Vehicle_ID long, Frame_ID long, Local_X double, v_Vel double")
    r = canonical(df).first().asDict()
    assert r == {"id": 1, "frame": 2, "x": None, "speed": 3.0}
    with pytest.raises(ValueError):
        canonical(df.drop("Vehicle_ID"))
    with pytest.raises(ValueError):
        canonical(df.drop("Frame_ID"))


def test_raw_rows_and_tags(spark, tmp_path):
    (tmp_path / "us_1.csv").write_text("id,frame,x,y,xVelocity,yVelocity,laneId\n1,0,1.5,2,3,4,1\n1,oops,1,2,3,4,1\n")
    raw = recordings.read_raw(spark, [str(tmp_path)])
    rates = spark.createDataFrame([("us", "us_data", 10.0), ("us_1", "longer", 25.0), ("u", "short", 30.0)], "prefix string, dataset_name string, source_freq_hz double")
    assert recordings.quarantine_report(raw).first().asDict() == {"source_file": "us_1", "good_rows": 1, "bad_rows": 1}
    tagged = recordings.tagged(recordings.good_rows(raw), rates).collect()
    assert [(r.dataset_name, r.source_freq_hz) for r in tagged] == [("longer", 25.0)]
    assert recordings.quarantined(raw).first()._bad == "frame"
    many = rates.unionByName(spark.range(10_000).select(F.concat(F.lit("us_"), F.col("id").cast("string"), F.lit("x")).alias("prefix"), F.lit("other").alias("dataset_name"), F.lit(1.0).alias("source_freq_hz")))
    assert [(r.dataset_name, r.source_freq_hz) for r in recordings.tagged(raw, many, recordings.recordings_of(spark, [str(tmp_path)])).collect()] == [("longer", 25.0)] * 2
    assert recordings.tagged(raw, rates.where("prefix = 'none'")).first().dataset_name is None


def test_columns_are_found_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("frame,id,y,x,width,xVelocity\n7,1,-3.5,10.25,1.8,20\n8,1,-3.5,NaN,1.8,fast\n9,1,-3.5\n10,1,2,3,4,5,6\n")
    (tmp_path / "b.csv").write_text("v_Vel,Local_X,Vehicle_ID,Global_Time,Frame_ID,Frame_ID\n20.5,1,4,1118846979700,3,9\n")
    (tmp_path / "c.csv").write_text("trackId,x\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    raw = recordings.read_raw(spark, [str(tmp_path)], keep=("width",))
    assert raw.columns == [*(f.name for f in recordings.RAW), "width", "_bad", "source_file"]
    got = {(r.source_file, r.frame): r for r in raw.collect()}
    r = got["a", 7]
    assert (r.id, r.x, r.y, r.xVelocity, r.width, r._bad, r.speed) == (1, 10.25, -3.5, 20.0, "1.8", None, None)
    assert got["a", 8].x is None and got["a", 8]._bad == "xVelocity" and got["a", 9]._bad == got["a", 10]._bad == "fields"
    r = got["b", 3]
    assert (r.id, r.x, r.speed, r.timestamp, r.xVelocity, r.laneId) == (4, 1.0, 20.5, 1118846979700.0, None, None)
    expected = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "source_file string")
    report = {r.source_file: (r.status, r.good_rows, r.bad_rows, r.reasons) for r in recordings.recording_report(raw, expected).collect()}
    assert report == {"a": ("partial", 1, 3, {"xVelocity": 1, "fields": 2}), "b": ("ok", 1, 0, None), "c": ("failed", 0, 1, {"key": 1}), "d": ("missing", 0, 0, None), "e": ("missing", 0, 0, None)}
    assert recordings.read_raw(spark, [str(tmp_path / "d.csv")]).count() == 0


def test_recordings_of_several_rates_and_columns(spark):
    rows = track(1, 90, file="slow") + track(2, 225, lambda p: 0.8 * p, file="fast")
    df = spark.createDataFrame(rows, TRACK).withColumn("xVelocity", F.when(F.col("source_file") == "fast", F.col("xVelocity")))
    rates = spark.createDataFrame([("slow", 10.0), ("fast", 25.0), ("odd", 7.0)], "source_file string, source_freq_hz double")
    made = processed_recordings(df, rates)
    assert {(r.source_file, r.source_freq_hz, r["count"]) for r in made.groupBy("source_file", "source_freq_hz").count().collect()} == {("slow", 10.0, 45), ("fast", 25.0, 45)}
    slow = made.where("source_file = 'slow'").collect()
    assert all(r.xVelocity == r.vx_recomputed for r in slow)
    index = windows.window_index(made, "source_freq_hz", anchor=True).where("start_frame = 5").collect()
    assert {(r.source_file, r.anchor_frame, r.anchor_time_sec) for r in index} == {("slow", 38, 3.8), ("fast", 95, 3.8)}
    found = processed_recordings(spark.createDataFrame(track(1, 90, lambda p: 2.0 * p), TRACK))
    assert found.first().source_freq_hz == 10.0
    with pytest.raises(ValueError):
        processed_recordings(df, rates.where("source_freq_hz = 7"))


def test_standing_and_unknown_ego_are_counted(spark):
    rows = [("d", "rec", i, 14, 10.0 * i, 0.0, v, 0.0, 1) for i, v in ((1, 10.0), (2, 0.0), (3, None))]
    df = spark.createDataFrame(rows, TRACK).withColumn("pos", F.lit(14).cast("long"))
    index = spark.createDataFrame([(f"w{i}", "rec", i, 0, 15) for i in (1, 2, 3)], "window_id string, source_file string, vehicle_id long, start_frame long, n_frames_hist int")
    r = neighbors.window_quality(neighbors.surroundings(index, df)).first()
    assert (r.windows, r.without_velocity, r.standing) == (3, 1, 1)


def test_window_features_with_and_without_changes_in_the_index(spark):
    processed, index = tracks_to_windows(spark.createDataFrame(track(1, 120, lane=1) + track(2, 120, y=lambda p: 3.0 + 0.05 * p), TRACK), 10.0)
    more = windows.window_index(processed, 10.0, changes=True)
    a, b = (sorted(map(tuple, features.window_features(i, processed).collect()), key=repr) for i in (index, more))
    assert a == b and len(a) == index.count()


def test_samples_have_fixed_shapes(spark):
    rows = track(1, 100) + track(2, 100, lambda p: 20.0 * p + 2, lambda p: 3.0) + track(3, 60, lambda p: 20.0 * p - 12, lambda p: 3.0)
    processed, index = tracks_to_windows(spark.createDataFrame(rows, TRACK), 10.0)
    slots = neighbors.slot_table(neighbors.surroundings(index, processed))
    table = features.window_features(index, processed)
    assert len(table.columns) == 78
    for align in ("position", "frame"):
        for r in samples.samples(index, slots, table, processed, align=align, zero_masked=True).collect():
            hist = np.array(r.hist)
            assert hist.shape == (7, 15, 4) and np.array(r.fut).shape == (25, 2) and np.array(r.interaction_feats).shape == (6, 15, 6)
            assert np.allclose(hist[0, -1, :2], 0, atol=1e-3)
            assert all(not hist[i + 1].any() for i, m in enumerate(r.mask_fixed6) if not m)


def test_long_tracks_lie_in_bounded_chunks(spark):
    long = spark.range(20_000).select(F.lit("rec").alias("source_file"), F.lit(1).cast("long").alias("id"), F.col("id").alias("pos"), *[(F.col("id") * k).cast("double").alias(c) for k, c in enumerate(("x_smooth", "y_smooth", "xVelocity", "yVelocity"), 1)])
    chunks = samples.track_chunks(long, rows=100)
    sizes = chunks.states.agg(F.max(F.size("states")), F.count("*"), F.min(F.size("states"))).first()
    assert tuple(sizes) == (139, 200, 100)
    index = long.where("pos % 5 = 0 and pos <= 19960").select(F.col("pos").cast("string").alias("window_id"), "source_file", F.col("id").alias("vehicle_id"), F.col("pos").alias("start_frame"))
    rows = samples.ego_arrays(index, long, chunks=chunks).collect()
    assert len(rows) == 3993 and all([h[0] for h in r.ego_hist] == list(range(int(r.window_id), int(r.window_id) + 15)) and r.ego_fut[-1] == [int(r.window_id) + 39, 2 * (int(r.window_id) + 39)] for r in rows)
    with pytest.raises(ValueError):
        samples.track_chunks(long, rows=20)


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def _few_windows(spark):
    df = spark.createDataFrame([r for v in range(6) for r in track(v, 200, lambda p, v=v: 20.0 * p + 3 * v, lambda p, v=v: 3.0 * v)], TRACK)
    processed = recordings.kept(processed_tracks(df, 10.0), "t")
    return processed, recordings.kept(windows.window_index(processed, 10.0, changes=True), "i")


def test_tables_of_windows_are_not_broadcast_to_samples(spark):
    processed, index = _few_windows(spark)
    assert _broadcasts(neighbors.surroundings(index, processed)) == 0
    around = recordings.kept(neighbors.surroundings(index, processed), "a")
    made = samples.samples(index, neighbors.slot_table(around), around, processed, chunks=samples.kept_chunks(processed))
    assert _broadcasts(made) == 1, "the tracks' lengths only, which are counted"
    assert made.count() == index.count() > 0


def test_splits_of_windows_are_not_broadcast_to_samples(spark):
    processed, index = _few_windows(spark)
    assert _broadcasts(features_to_samples(index, processed)) == 1, "the tracks' lengths only, which are counted"


def _shuffled(df, table):
    """Whether a scan of the table is exchanged before it is joined."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    found = False
    for i, line in enumerate(lines):
        if table not in line:
            continue
        found, at = True, depth(line)
        for above in reversed(lines[:i]):
            if depth(above) < at:
                at = depth(above)
                if "Join" in above:
                    break
                if "Exchange" in above:
                    return True
    assert found
    return False


def test_tracks_in_buckets_are_not_shuffled(spark, tmp_path):
    df = spark.createDataFrame([r for v in range(6) for r in track(v, 200, lambda p, v=v: 20.0 * p + 3 * v, lambda p, v=v: 3.0 * v)], TRACK)
    processed = recordings.kept(processed_tracks(df, 10.0), "t")
    plain = recordings.kept(windows.window_index(processed, 10.0, changes=True), "i")
    index = recordings.kept(windows.window_index(processed, 10.0, changes=True, ego=True), "i")
    scenes, chunks = neighbors.stored_scenes(processed, 5), samples.kept_chunks(processed, buckets=5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made, ego = features.window_features(index, scenes), samples.ego_arrays(index, None, chunks=chunks)
        near = samples.neighbor_histories(index, neighbors.slot_table(recordings.kept(neighbors.surroundings(index, scenes), "a")), None, chunks=chunks)
        assert not _shuffled(made, "spark_catalog.default.scenes_") and not _shuffled(ego, "spark_catalog.default.chunks_") and not _shuffled(near, "spark_catalog.default.chunks_")
        assert _shuffled(features.window_features(plain, processed), "FileScan parquet [source_file")
        rows = lambda t: sorted(map(tuple, t.collect()), key=repr)
        assert rows(made) == rows(features.window_features(plain, processed)) and rows(ego) == rows(samples.ego_arrays(plain, processed))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_run_goes_on_after_a_crash(spark, tmp_path):
    out, manifest = str(tmp_path / "out"), str(tmp_path / "manifest")
    df = spark.createDataFrame([r for i in range(5) for r in track(1, 10 + i, file=f"rec_{i}")], TRACK)
    names = df.select("source_file").distinct()
    calls = []

    def make(torn, lost=False):
        def outputs(some):
            calls.append(some)
            x = F.when(F.col("source_file") == torn, F.raise_error(F.lit("torn")).cast("double")).otherwise(F.col("x"))
            made = some.select("source_file", "id", "frame", x.alias("x"))
            if lost:
                made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(f"{out}/tracks")
                raise KeyboardInterrupt
            return {"tracks": made}

        return outputs

    with pytest.raises(KeyboardInterrupt):  # the driver dies after its data and before its manifest
        resumable.run(df, names, make(None, lost=True), out, manifest)
    assert spark.read.parquet(f"{out}/tracks").count() == 60 and resumable.history(spark, manifest).count() == 0
    got = {r.source_file: (r.attempt, r.status, r.rows) for r in resumable.run(df, names, make("rec_2"), out, manifest, batch=10).collect()}
    assert got == {f"rec_{i}": (1, "failed", None) if i == 2 else (1, "ok", {"tracks": 10 + i}) for i in range(5)}
    assert "torn" in resumable.state_of(spark, manifest).where("status = 'failed'").first().reason
    calls.clear()
    got = {r.source_file: (r.attempt, r.status) for r in resumable.run(df, names, make(None), out, manifest).collect()}
    assert got == {f"rec_{i}": (2 if i == 2 else 1, "ok") for i in range(5)} and len(calls) == 1 and calls[0].count() == 12
    assert spark.read.parquet(f"{out}/tracks").count() == 60 and resumable.history(spark, manifest).count() == 6


def test_bad_recordings_are_found_in_few_rounds(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([r for i in range(40) for r in track(1, 10 + i, file=f"rec_{i}")] + track(1, 5, file=""), TRACK)
    names, bad = df.select("source_file").distinct().where("source_file <> ''"), {f"rec_{i}" for i in range(0, 40, 5)}

    def make(some):
        x = F.when(F.col("source_file").isin(*bad), F.raise_error(F.lit("torn")).cast("double")).otherwise(F.col("x"))
        return {"tracks": some.select("source_file", "id", "frame", x.alias("x")), "none": some.where("x < -1").select("source_file", "id")}

    for rows in (resumable.ROWS_PER_TASK, 0):  # in one task each, and by shuffles
        monkeypatch.setattr(resumable, "ROWS_PER_TASK", rows)
        out, manifest = tmp_path / f"out{rows}", tmp_path / f"manifest{rows}"
        got = {r.source_file: (r.attempt, r.status, r.rows) for r in resumable.run(df, names, make, str(out), str(manifest)).collect()}
        assert got == {f: (1, "failed", None) if f in bad else (1, "ok", {"tracks": 10 + int(f[4:]), "none": 0}) for f in (f"rec_{i}" for i in range(40))}
        assert len(list(manifest.glob("*.parquet"))) == 2, "parts of two or three recordings, then single ones"
        stored = {r.source_file: r["count"] for r in spark.read.parquet(f"{out}/tracks").groupBy("source_file").count().collect()}
        assert {f: n for f, n in stored.items() if f not in bad} == {f"rec_{i}": 10 + i for i in range(40) if f"rec_{i}" not in bad}


def test_stream_takes_each_recording_once(spark, tmp_path):
    source = str(tmp_path / "in")
    out = [str(tmp_path / x) for x in ("tracks", "index", "state")]
    for i in (1, 2):
        spark.createDataFrame(track(i, 90, file=f"rec_{i}"), TRACK).coalesce(1).write.mode("append").parquet(source)
        process_new(spark, source, *out, 10.0).awaitTermination()
    index = spark.read.parquet(out[1])
    assert {(r.source_file, r["count"]) for r in index.groupBy("source_file").count().collect()} == {("rec_1", 2), ("rec_2", 2)}


def test_samples_of_the_third_workload(spark):
    rows = track(1, 900) + track(2, 900, lambda p: 20.0 * p + 2, lambda p: 3.0)
    processed, index = tracks_to_windows(spark.createDataFrame(rows, TRACK), 10.0)
    made = features_to_samples(index, processed)
    kept = splits.time_split(index)
    assert {(r.window_id, r.split) for r in made.select("window_id", "split").collect()} == {(r.window_id, r.split) for r in kept.select("window_id", "split").collect()}
    train = made.where("split = 'train'").collect()
    assert all(np.array(r.interaction_feats).shape == (6, 15, 6) and r.source_freq == 10.0 and r.scene_density == 1 for r in train)
    # The first vehicle drifts by 7.8 m a window, the second keeps its lane.
    assert {(r.window_id.split("_")[1], r.is_lane_change) for r in train} == {("1", True), ("2", False)}
