"""Queries over tracks derived from the test tables, one for each operator or small group of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, frequency, neighbors, resample, samples, smoothing, splits, windows
from ..sources import recordings
from ..sources.canonical import canonical, of_dataset
from ..sources.track_view import track_view
from . import resumable
from .oracles import ORACLES
from .workloads import features_to_samples, processed_recordings, processed_tracks, recording_rates, split_windows, windows_to_features

HZ = 10.0
__all__ = ["ORACLES", "QUERIES"]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, where a column is a plain double."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def _processed(spark: SparkSession, sf: str) -> DataFrame:
    return processed_tracks(track_view(spark, sf), HZ)


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    processed = _processed(spark, sf)
    return processed, windows.window_index(processed, HZ)


def _kept(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """As _both, with 5 Hz tracks and index written between the workloads, since features and samples read them several times."""
    processed = recordings.kept(_processed(spark, sf), "tracks")
    return processed, recordings.kept(windows.window_index(processed, HZ, changes=True), "index")


def _around(spark: SparkSession, sf: str) -> DataFrame:
    processed, index = _kept(spark, sf)
    return neighbors.surroundings(index, processed)


def canonical_columns(spark, sf):
    """Raw columns under other names, as recordings have them, back to canonical ones; one data set, with file tags."""
    named = {"id": "Vehicle_ID", "frame": "Frame_ID", "x": "Local_X", "y": "Local_Y", "xVelocity": "vx", "yVelocity": "v_y", "global_time_ms": "Global_Time"}
    raw = track_view(spark, sf).withColumnsRenamed(named)
    tag = F.concat_ws("_", "dataset_name", F.lpad(F.regexp_extract("source_file", r"(\d+)", 1), 2, "0"))
    rows = of_dataset(canonical(raw), "corridor_a").withColumn("file_tag", tag)
    return _rounded(rows.select("id", "frame", "timestamp", "x", "y", "xVelocity", "yVelocity", "file_tag"))


def rate_from_timestamp(spark, sf):
    return _rounded(frequency.rate_from_timestamp(canonical(track_view(spark, sf))))


def rate_from_timestamp_only(spark, sf):
    return _rounded(frequency.rate_from_timestamp_only(canonical(track_view(spark, sf).drop("frame"))))


def rate_report(spark, sf):
    """Recordings without timestamps: the rate comes from positions and velocities."""
    return _rounded(frequency.rate_report(canonical(track_view(spark, sf).drop("global_time_ms"))))


def smooth_positions(spark, sf):
    return _rounded(smoothing.smooth_positions(track_view(spark, sf), HZ).select("source_file", "id", "frame", "x_smooth", "y_smooth"))


def smoothing_report(spark, sf):
    return _rounded(smoothing.smoothing_report(smoothing.smooth_positions(track_view(spark, sf), HZ), HZ), 4)


def downsample(spark, sf):
    rows = resample.downsample(smoothing.smooth_positions(track_view(spark, sf), HZ), HZ)
    return _rounded(rows.select("source_file", "id", "frame", "pos", "x_smooth", "y_smooth"))


def kinematics(spark, sf):
    columns = ("source_file", "id", "frame", "vx_recomputed", "vy_recomputed", "xAcceleration", "yAcceleration")
    return _rounded(_processed(spark, sf).select(*columns))


def segments(spark, sf):
    return _processed(spark, sf).select("source_file", "id", "frame", "pos", "frame_gap", "mode_gap", "segment_id")


def neighbor_slots(spark, sf):
    return _rounded(neighbors.slot_table(_around(spark, sf)).select("window_id", "slot_no", "slot", "mask", "id", "x", "y", "vx", "vy", "lane"))


def slot_risk(spark, sf):
    return _rounded(neighbors.slot_table(_around(spark, sf)).select("window_id", "slot_no", "mask", "ttc", "ttc_valid", "thw", "rel_vx", "rel_vy"))


def ttc_own_lane(spark, sf):
    return _rounded(neighbors.own_lane_risk(_around(spark, sf)))


def scene_density(spark, sf):
    ego = F.col("ego")
    return _rounded(_around(spark, sf).select("window_id", "scene_density", ego["xVelocity"].alias("ego_vx"), ego["yVelocity"].alias("ego_vy"), ego["laneId"].alias("ego_lane")))


def window_features(spark, sf):
    processed, index = _kept(spark, sf)
    return _rounded(features.window_features(index, processed))


def _stored(spark, sf, buckets: int = 16):
    """Index with the vehicles' states at their anchors, scenes and chunks in buckets."""
    processed = recordings.kept(_processed(spark, sf), "tracks")
    index = recordings.kept(windows.window_index(processed, HZ, changes=True, ego=True), "index")
    return index, neighbors.stored_scenes(processed, buckets), samples.kept_chunks(processed, buckets=buckets)


def stored_features(spark, sf):
    """window_features from tables in buckets: windows are shuffled, tracks are not."""
    index, scenes, _ = _stored(spark, sf)
    return _rounded(features.window_features(index, scenes))


def stored_histories(spark, sf):
    """ego_arrays from chunks in buckets, which are not shuffled."""
    index, _, chunks = _stored(spark, sf)
    made = samples.ego_arrays(index, None, chunks=chunks).select("window_id", F.concat("ego_hist", "ego_fut").alias("w"))
    return _rounded(_states(made, "w", "window_id"), 3)


def feature_summary(spark, sf):
    processed, index = _kept(spark, sf)
    return features.feature_summary(features.window_features(index, processed), index)


def resume_windows(spark, sf):
    """Windows of vehicles with an odd number, as those of the others are taken to be done."""
    index = _both(spark, sf)[1]
    return features.remaining(index, index.where("vehicle_id % 2 = 0")).select("window_id", "source_file", "start_frame")


def time_split(spark, sf):
    return splits.time_split(_both(spark, sf)[1]).select("window_id", "source_file", "split")


def split_summary(spark, sf):
    index = recordings.kept(_both(spark, sf)[1], "index")
    return _rounded(splits.split_summary(splits.time_split(index), index))


def split_overlap(spark, sf):
    """Splits with some train windows planted in val as well."""
    kept = recordings.kept(splits.time_split(_both(spark, sf)[1]), "split")
    planted = kept.where("split = 'train' and start_frame % 50 = 0").withColumn("split", F.lit("val"))
    return splits.split_overlap(kept.unionByName(planted))


def split_overlap_by_recording(spark, sf):
    """A split along the recordings' clock, checked on that clock, with windows planted that leak on it."""
    index = windows.window_index(_processed(spark, sf), HZ, anchor=True)
    kept = split_windows(index, time_basis="recording")
    planted = kept.where("split = 'test' and anchor_frame % 40 = 0").withColumn("split", F.lit("train"))
    return splits.split_overlap(kept.unionByName(planted), slab_s=30.0)


def _states(df: DataFrame, array: str, *keys: str) -> DataFrame:
    long = df.select(*keys, F.posexplode(array).alias("t", "s"))
    return long.select(*keys, F.col("t").cast("long").alias("t"), *[F.get("s", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("x", "y", "vx", "vy"))])


def ego_arrays(spark, sf):
    """Long form: one row per window and time."""
    processed, index = _both(spark, sf)
    joined = samples.ego_arrays(index, processed).select("window_id", F.concat("ego_hist", "ego_fut").alias("w"))
    return _rounded(_states(joined, "w", "window_id"), 3)


def neighbor_history(spark, sf):
    processed, index = _kept(spark, sf)
    slots = neighbors.slot_table(neighbors.surroundings(index, processed))
    return _rounded(_states(samples.neighbor_histories(index, slots, processed), "hist", "window_id", "slot_no"), 3)


def interaction_features(spark, sf):
    names = ("ttc", "thw", "rel_vx", "rel_vy", "ttc_valid", "mask")
    made = samples.interaction(neighbors.slot_table(_around(spark, sf)))
    return _rounded(made.select("window_id", "slot_no", *[F.col("f")[i].cast("double").alias(n) for i, n in enumerate(names)]), 4)


def _samples(spark, sf):
    processed, index = _kept(spark, sf)
    around = recordings.kept(neighbors.surroundings(index, processed), "surroundings")
    return samples.samples(index, neighbors.slot_table(around), around, processed, chunks=samples.kept_chunks(processed))


def normalized_samples(spark, sf):
    """Sums over time of each agent's normalised states; agent 0 is ego, -1 its future."""
    made = _samples(spark, sf)
    none = F.lit(None).cast("float")
    future = F.transform("fut", lambda s: F.array(s[0], s[1], none, none))
    each = made.select("window_id", F.posexplode(F.concat(F.array(future), "hist")).alias("place", "h"))
    total = lambda i: F.aggregate("h", F.lit(0.0), lambda sum, s: sum + F.round(s[i].cast("double"), 3))
    return _rounded(each.select("window_id", (F.col("place") - 1).alias("agent"), *[total(i).alias(n) for i, n in enumerate(("x", "y", "vx", "vy"))]), 3)


def sample_rows(spark, sf):
    """The split windows' samples but for their arrays of states: masks, scalars and interaction values of slots, at two times."""
    processed, index = _kept(spark, sf)
    made = features_to_samples(index, processed)
    slots = F.posexplode(F.arrays_zip("mask_fixed6", "valid_ttc_mask", F.col("interaction_feats").alias("f")))
    rows = made.select("window_id", "split", "is_lane_change", "scene_density", F.col("source_freq").cast("double").alias("source_freq"), slots.alias("slot_no", "s"))
    at = lambda t, i: F.col("s.f")[t][i].cast("double")
    same = F.forall("s.f", lambda f: f == F.col("s.f")[0])
    values = [at(14, i).alias(n) for i, n in enumerate(("ttc", "thw", "rel_vx", "rel_vy", "f_valid", "f_mask"))]
    return _rounded(rows.select("window_id", "split", "is_lane_change", "scene_density", "source_freq", F.col("slot_no").cast("long").alias("slot_no"), F.col("s.mask_fixed6").cast("double").alias("mask"), F.col("s.valid_ttc_mask").cast("double").alias("valid_ttc"), same.alias("constant"), *values), 4)


def split_by_recording(spark, sf):
    """Windows split along the recordings' clock instead of the tracks' own."""
    index = windows.window_index(_processed(spark, sf), HZ, anchor=True)
    return _rounded(splits.time_split(index, time_basis="recording").select("window_id", "source_file", "anchor_frame", "anchor_time_sec", "split"))


def window_quality(spark, sf):
    return neighbors.window_quality(_around(spark, sf))


def pipeline_info(spark, sf):
    return _rounded(smoothing.pipeline_info(smoothing.smooth_positions(track_view(spark, sf), HZ), HZ), 4)


def track_sink(spark, sf):
    """Processed tracks written in a folder per data set and recording and read back."""
    path = recordings.work_folder(spark, "tracks")
    recordings.write_partitioned(_processed(spark, sf), path, "dataset_name", "source_file")
    rows = spark.read.parquet(path).groupBy("dataset_name", "source_file")
    return _rounded(rows.agg(F.count("*").alias("rows"), F.sum("pos").alias("places"), F.sum("segment_id").alias("segments"), F.round(F.sum(F.round("x_smooth", 6)), 3).alias("x"), F.round(F.sum(F.round("yAcceleration", 6)), 3).alias("ay")), 3)


def index_sink(spark, sf):
    """The window index written in a folder per data set; of one data set only its folder is read back."""
    path = recordings.work_folder(spark, "index")
    recordings.write_partitioned(_both(spark, sf)[1], path, "dataset_name")
    return of_dataset(spark.read.parquet(path), "corridor_a").select("window_id", "source_file", "start_frame", "end_frame", "dataset_name")


def feature_sink(spark, sf):
    """A feature table begun with the windows of even vehicles, resumed for the others, and read back whole."""
    path = recordings.work_folder(spark, "features")
    processed, index = _kept(spark, sf)
    features.append_features(index.where("vehicle_id % 2 = 0"), processed, path)
    features.append_features(index, processed, path, done=spark.read.parquet(path).select("window_id"))
    return _rounded(spark.read.parquet(path))


def resumed_features(spark, sf):
    """The second workload for the windows that a feature table lacks."""
    processed, index = _kept(spark, sf)
    made = windows_to_features(index, processed, done=index.where("vehicle_id % 2 = 0"))
    return made.select("window_id", "is_lane_change", "scene_density", "left_preceding_mask", "right_following_id")


#: Three ways in which recordings name and order their columns; the second has neither velocities nor lanes.
_FORMS = (
    {"frame": "frame", "id": "id", "y": "y", "x": "x", "width": None, "xVelocity": "xVelocity", "yVelocity": "yVelocity", "laneId": "laneId"},
    {"Vehicle_ID": "id", "Frame_ID": "frame", "Global_Time": "global_time_ms", "Local_X": "x", "Local_Y": "y", "v_Vel": "xVelocity"},
    {"laneId": "laneId", "vx": "xVelocity", "v_y": "yVelocity", "trackId": "id", "Y": "y", "X": "x", "frameId": "frame"},
)


def _raw_files(spark, sf, path: str) -> DataFrame:
    """Recordings as CSV of three forms, with rows that are cut off or hold no number; the rows that were written well."""
    form = F.pmod(F.regexp_extract("source_file", r"(\d+)", 1).cast("int"), F.lit(3))
    good = track_view(spark, sf).withColumn("form", form)
    lines = None
    for i, columns in enumerate(_FORMS):
        value = lambda c, bad=None: F.lit("1.5") if c is None else F.lit(bad) if bad and c == "x" else F.col(c).cast("string")
        some = good.where(F.col("form") == i)
        line = F.concat_ws(",", *[value(c) for c in columns.values()])
        odd = F.concat_ws(",", *[value(c, "far") for c in columns.values()])
        cut = F.concat_ws(",", *[value(c) for c in list(columns.values())[:3]])
        head = some.select("source_file").distinct().select("source_file", F.lit(-1).cast("long").alias("n"), F.lit(",".join(columns)).alias("value"))
        body = some.select("source_file", F.col("frame").alias("n"), line.alias("value"))
        bad = some.where("frame % 100 = 0").select("source_file", F.col("frame").alias("n"), odd.alias("value")).unionByName(some.where("frame % 150 = 0").select("source_file", F.col("frame").alias("n"), cut.alias("value")))
        part = head.unionByName(body).unionByName(bad)
        lines = part if lines is None else lines.unionByName(part)
    one_file = lines.repartition("source_file").sortWithinPartitions("source_file", "n")
    one_file.select("source_file", "value").write.partitionBy("source_file").text(path)
    return good


def raw_recordings(spark, sf):
    """CSV files of different headers, through rate detection and processing, as one table of 5 Hz tracks."""
    path = recordings.work_folder(spark, "raw")
    _raw_files(spark, sf, path)
    raw = recordings.read_raw(spark, [path], name=r"source_file=([^/]+)")
    rates = track_view(spark, sf).select("source_file").distinct().select("source_file", F.lit(HZ).alias("source_freq_hz"))
    made = processed_recordings(recordings.good_rows(raw), rates)
    return _rounded(made.select("source_file", "id", "frame", "timestamp", "speed", "xVelocity", "yVelocity", "laneId", "pos", "segment_id", "source_freq_hz"))


def detected_recordings(spark, sf):
    """As raw_recordings, with each recording's rate told from its own rows: times in some files, velocities in others."""
    path = recordings.work_folder(spark, "raw")
    _raw_files(spark, sf, path)
    raw = recordings.good_rows(recordings.read_raw(spark, [path], name=r"source_file=([^/]+)"))
    made = processed_recordings(raw).withColumn("dataset_name", F.lit("all"))
    index = windows.window_index(made, "source_freq_hz")
    return index.groupBy("source_file", "source_freq_hz").agg(F.count("*").alias("windows"), F.sum("start_frame").alias("starts"))


def _number() -> Column:
    return F.regexp_extract("source_file", r"(\d+)", 1).cast("int")


def rate_evidence(spark, sf):
    """Rates of recordings that differ in what they hold: frames and times, velocities, speeds, neither, or times alone."""
    kind = F.pmod(_number(), F.lit(5))
    rows = canonical(track_view(spark, sf)).withColumn("speed", F.when(kind == 2, F.sqrt(F.col("xVelocity") * F.col("xVelocity") + F.col("yVelocity") * F.col("yVelocity"))))
    rows = rows.withColumns({"timestamp": F.when(kind.isin(0, 4), F.col("timestamp")), "xVelocity": F.when(kind.isin(0, 1), F.col("xVelocity")), "frame": F.when(kind != 4, F.col("frame"))})
    return _rounded(frequency.rate_report(rows))


def rate_report_of_sample(spark, sf):
    """As rate_report, from three vehicles of each recording, and which these are."""
    rows = canonical(track_view(spark, sf).drop("global_time_ms"))
    some = frequency.sampled(rows, 3).groupBy("source_file").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    found = frequency.rate_report(rows, vehicles=3).select("source_file", "detected_freq_hz", "low_confidence", "mode_gap")
    return found.join(some, "source_file").select("source_file", "detected_freq_hz", "low_confidence", "mode_gap", F.size("ids").cast("long").alias("vehicles"))


def _given_rates(spark, sf, *rates):
    """Recordings in turn with the given rates, as a table."""
    which = F.get(F.array(*[F.lit(r).cast("double") for r in rates]), F.pmod(_number(), F.lit(len(rates))))
    return track_view(spark, sf).select("source_file").distinct().select("source_file", which.alias("source_freq_hz"))


def many_rates(spark, sf):
    """Recordings of four rates through one plan: smoothed over 5, 9, 9 and 15 rows, every 2nd, 5th, 6th or 10th row kept."""
    made = processed_recordings(track_view(spark, sf), _given_rates(spark, sf, 10.0, 25.0, 30.0, 50.0))
    return _rounded(made.select("source_file", "id", "frame", "pos", "x_smooth", "y_smooth", "vx_recomputed", "xAcceleration", "segment_id", "source_freq_hz"))


def unfit_recordings(spark, sf):
    """What is done to each recording at its rate, or why it can't be: one rate is no whole multiple, one is too high, one unknown."""
    return recording_rates(track_view(spark, sf), _given_rates(spark, sf, 10.0, 7.0, 1000.0, None, 25.0))


def merged_summary(spark, sf):
    """Summaries of one data set's recordings stored, those of the other added, and merged on read; ids are near the exact count."""
    index = recordings.kept(_both(spark, sf)[1], "index")
    path = recordings.work_folder(spark, "summaries")
    for part in ("dataset_name = 'corridor_a'", "dataset_name <> 'corridor_a'"):
        windows.recording_summaries(index.where(part)).write.mode("append").parquet(path)
    merged, exact = windows.merged_summary(spark.read.parquet(path)), windows.index_summary(index)
    same = lambda c: F.col(f"m.{c}").eqNullSafe(F.col(f"e.{c}"))
    both = merged.alias("m").join(exact.alias("e"), same("dataset_name") & same("source_file"))
    return both.select(*[F.col(f"m.{c}").alias(c) for c in ("dataset_name", "source_file", "windows", "vehicles", "files")], (F.abs(F.col("m.vehicle_ids") - F.col("e.vehicle_ids")) <= 0.05 * F.col("e.vehicle_ids")).alias("ids_near"))


def recording_manifest(spark, sf):
    """The first workload by recordings: one has no rate, one breaks off in processing; then both are mended and the run resumed.

    What the manifest says of each recording, and how many rows lie in the outputs.
    """
    out, manifest = recordings.work_folder(spark, "out"), recordings.work_folder(spark, "manifest")
    tracks = recordings.kept(track_view(spark, sf), "view")
    number = F.pmod(_number(), F.lit(5))

    def make(broken):
        def outputs(some):
            x = F.when(F.lit(broken) & (number == 2), F.raise_error(F.lit("sensor file is torn")).cast("double")).otherwise(F.col("x"))
            processed = processed_tracks(some.withColumn("x", x), HZ)
            return {"tracks": processed.select("source_file", "id", "frame", "pos", "x_smooth"), "index": windows.window_index(processed, HZ).select("source_file", "window_id")}

        return outputs

    names = tracks.select("source_file").distinct()
    first = resumable.run(tracks, names.withColumn("problem", F.when(number == 1, "no_rate")), make(True), out, manifest)
    first = recordings.kept(first.select("source_file", F.col("status").alias("first_status"), F.when(F.col("reason") == "no_rate", "no_rate").when(F.contains("reason", F.lit("sensor file is torn")), "torn").alias("first_reason")), "first")
    then = resumable.run(tracks, names, make(False), out, manifest)
    stored = spark.read.parquet(f"{out}/tracks").groupBy("source_file").agg(F.count("*").alias("stored"))
    made = then.join(first, "source_file").join(stored, "source_file")
    return made.select("source_file", "first_status", "first_reason", "status", "attempt", F.col("rows")["tracks"].alias("tracks"), F.col("rows")["index"].alias("windows"), "stored")


def tagged_recordings(spark, sf):
    """Files of several families tagged by the longest prefix of their names, from a table of as many prefixes as suppliers."""
    path = recordings.work_folder(spark, "raw")
    _raw_files(spark, sf, path)
    name = r"source_file=([^/]+)"
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet")
    family = suppliers.select(F.concat(F.lit("rec_"), F.col("s_suppkey").cast("string")).alias("prefix"), F.concat(F.lit("site_"), F.col("s_nationkey").cast("string")).alias("dataset_name"), (F.col("s_suppkey") % 5 * 5 + 5).cast("double").alias("source_freq_hz"))
    rates = family.unionByName(spark.createDataFrame([("rec", "other", 10.0)], "prefix string, dataset_name string, source_freq_hz double"))
    rows = recordings.tagged(recordings.read_raw(spark, [path], name=name), rates, recordings.recordings_of(spark, [path], name))
    return rows.groupBy("source_file", "dataset_name", "source_freq_hz").agg(F.count("*").alias("rows"))


def recording_report(spark, sf):
    """What was read of each recording and why rows are bad, and one that was expected and is not there."""
    path = recordings.work_folder(spark, "raw")
    _raw_files(spark, sf, path)
    raw = recordings.read_raw(spark, [path], name=r"source_file=([^/]+)")
    expected = track_view(spark, sf).select("source_file").distinct().unionByName(spark.createDataFrame([("rec_lost",)], "source_file string"))
    report = recordings.recording_report(raw, expected)
    count = lambda c: F.coalesce(F.try_element_at("reasons", F.lit(c)), F.lit(0)).alias(f"bad_{c}")
    return report.select("source_file", "status", "good_rows", "bad_rows", count("x"), count("fields"))


def sink_round_trip(spark, sf):
    """The split index written in a folder per split and read back by partition."""
    path = recordings.work_folder(spark, "splits")
    recordings.write_partitioned(splits.time_split(_both(spark, sf)[1]), path, "split")
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("windows"), F.sum("start_frame").alias("start_frames"))


def input_quarantine(spark, sf):
    """Recordings written as CSV with a bad row beside every hundredth frame's, and what of them is good and bad."""
    path = recordings.work_folder(spark, "raw")
    columns = ["id", "frame", "x", "y", "xVelocity", "yVelocity", "laneId"]
    good = track_view(spark, sf).select("source_file", *[F.col(c).cast("string").alias(c) for c in columns])
    bad = good.where(F.col("frame") % 100 == 0).withColumn("x", F.lit("not a number"))
    good.unionByName(bad).write.partitionBy("source_file").option("header", True).csv(path)
    raw = recordings.read_raw(spark, [path], name=r"source_file=([^/]+)")
    return recordings.quarantine_report(raw)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "canonical_columns": canonical_columns,
    "gap_histogram": lambda s, d: _rounded(frequency.gap_histogram(track_view(s, d))),
    "rate_from_timestamp": rate_from_timestamp,
    "rate_from_timestamp_only": rate_from_timestamp_only,
    "rate_from_velocity": lambda s, d: _rounded(frequency.rate_from_velocity(track_view(s, d))),
    "rate_report": rate_report,
    "track_quality": lambda s, d: smoothing.track_quality(track_view(s, d)),
    "smooth_positions": smooth_positions,
    "smoothing_report": smoothing_report,
    "downsample": downsample,
    "downsample_report": lambda s, d: _rounded(resample.downsample_report(track_view(s, d), HZ)),
    "kinematics": kinematics,
    "segments": segments,
    "segment_summary": lambda s, d: windows.segment_summary(_processed(s, d)),
    "window_index": lambda s, d: _rounded(_both(s, d)[1]),
    "index_summary": lambda s, d: windows.index_summary(_both(s, d)[1]),
    "direction_groups": lambda s, d: neighbors.direction_groups(track_view(s, d)),
    "neighbor_slots": neighbor_slots,
    "slot_risk": slot_risk,
    "ttc_own_lane": ttc_own_lane,
    "lane_change": lambda s, d: windows.lane_changes(_processed(s, d)),
    "scene_density": scene_density,
    "window_features": window_features,
    "feature_summary": feature_summary,
    "resume_windows": resume_windows,
    "time_split": time_split,
    "split_summary": split_summary,
    "split_overlap": split_overlap,
    "split_overlap_by_recording": split_overlap_by_recording,
    "ego_arrays": ego_arrays,
    "neighbor_history": neighbor_history,
    "interaction_features": interaction_features,
    "normalized_samples": normalized_samples,
    "sink_round_trip": sink_round_trip,
    "input_quarantine": input_quarantine,
    "sample_rows": sample_rows,
    "split_by_recording": split_by_recording,
    "window_quality": window_quality,
    "pipeline_info": pipeline_info,
    "track_sink": track_sink,
    "index_sink": index_sink,
    "feature_sink": feature_sink,
    "resumed_features": resumed_features,
    "raw_recordings": raw_recordings,
    "detected_recordings": detected_recordings,
    "recording_report": recording_report,
    "rate_evidence": rate_evidence,
    "rate_report_of_sample": rate_report_of_sample,
    "many_rates": many_rates,
    "unfit_recordings": unfit_recordings,
    "tagged_recordings": tagged_recordings,
    "stored_features": stored_features,
    "stored_histories": stored_histories,
    "merged_summary": merged_summary,
    "recording_manifest": recording_manifest,
}
