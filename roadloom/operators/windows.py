"""Sub-tracks without gaps and the sliding windows in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.tracks import KEYS, LANE_WIDTH_M, in_order, whole_track

INDEX_COLUMNS = ("window_id", "source_file", "dataset_name", "vehicle_id", "segment_id", "start_frame", "end_frame", "start_time_sec", "end_time_sec", "n_frames_hist", "n_frames_fut", "source_freq_hz", "target_freq_hz")


#: What is known of a vehicle at one moment.
STATE = ("x", "y", "xVelocity", "yVelocity", "laneId")


def segment() -> WindowSpec:
    return Window.partitionBy(*KEYS, "segment_id")


def frames(seconds: float, hz: float) -> int:
    """Whole frames of a time, or ValueError."""
    n = seconds * hz
    if abs(n - round(n)) > 1e-6:
        raise ValueError(f"{seconds} s at {hz} Hz is no whole number of frames")
    return round(n)


@dataclass(frozen=True)
class Shape:
    """Seconds of history and future, and between windows, at a rate."""

    hist_s: float = 3.0
    fut_s: float = 5.0
    stride_s: float = 1.0
    hz: float = 5.0

    @property
    def hist(self) -> int:
        return frames(self.hist_s, self.hz)

    @property
    def fut(self) -> int:
        return frames(self.fut_s, self.hz)

    @property
    def length(self) -> int:
        return self.hist + self.fut

    @property
    def stride(self) -> int:
        return frames(self.stride_s, self.hz)


def segments(tracks: DataFrame) -> DataFrame:
    """tracks with frame_gap, mode_gap (the track's commonest, ties to the smallest) and segment_id, which rises where a gap is another."""
    gaps = tracks.withColumn("frame_gap", F.col("frame") - F.lag("frame").over(in_order()))
    moded = gaps.withColumn("mode_gap", F.mode("frame_gap", True).over(whole_track()))
    jump = F.coalesce((F.col("frame_gap") != F.col("mode_gap")).cast("long"), F.lit(0))
    return moded.withColumn("segment_id", F.sum(jump).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def window_starts(segmented: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Rows at which a complete window begins, with start_frame, the row's place in the whole track; complete windows only."""
    order = segment().orderBy("frame")
    p, n = F.row_number().over(order) - 1, F.count("*").over(segment())
    return segmented.withColumns({"_q": p, "_n": n}).where((F.col("_q") % shape.stride == 0) & (F.col("_q") + shape.length <= F.col("_n"))).drop("_q", "_n")


def window_index(segmented: DataFrame, source_hz: float | str, shape: Shape = Shape(), anchor: bool = False, changes: bool = False, ego: bool = False) -> DataFrame:
    """One row per window of INDEX_COLUMNS. Windows are numbered by their place in the whole track, so their ids are unique.

    source_hz is a rate, or the name of a column that holds it. anchor adds anchor_frame, the frame of the last history row,
    and anchor_time_sec, its time on the recording's clock; changes adds is_lane_change; ego adds ego_at_anchor, the vehicle's
    state in that row, so that its neighbours are found without a join to the vehicle's track. None of them needs a join.
    """
    dt = 1.0 / shape.hz
    start = F.col("pos")
    hz = F.col(source_hz) if isinstance(source_hz, str) else F.lit(float(source_hz))
    more = []
    if anchor:
        segmented = segmented.withColumn("anchor_frame", F.lead("frame", shape.hist - 1).over(segment().orderBy("frame")))
        more += [F.col("anchor_frame"), (F.col("anchor_frame") / hz).alias("anchor_time_sec")]
    if changes:
        segmented = segmented.withColumn("is_lane_change", _changed(segmented, shape))
        more.append(F.col("is_lane_change"))
    if ego:
        state = F.struct("frame", *STATE)
        segmented = segmented.withColumn("ego_at_anchor", F.lead(state, shape.hist - 1).over(segment().orderBy("frame")))
        more.append(F.col("ego_at_anchor"))
    return window_starts(segmented, shape).select(
        F.concat_ws("_", "source_file", F.col("id").cast("string"), start.cast("string")).alias("window_id"), "source_file", "dataset_name",
        F.col("id").alias("vehicle_id"), "segment_id", start.alias("start_frame"), (start + shape.length).alias("end_frame"),
        (start * F.lit(dt)).alias("start_time_sec"), ((start + shape.length - 1) * F.lit(dt)).alias("end_time_sec"),
        F.lit(shape.hist).alias("n_frames_hist"), F.lit(shape.fut).alias("n_frames_fut"), hz.alias("source_freq_hz"), F.lit(float(shape.hz)).alias("target_freq_hz"), *more,
    )


def _changed(segmented: DataFrame, shape: Shape, lane_width: float = LANE_WIDTH_M) -> Column:
    span = segment().orderBy("frame").rowsBetween(0, shape.length - 1)
    y = "y_smooth" if "y_smooth" in segmented.columns else "y"
    lanes = F.size(F.collect_set("laneId").over(span)) > 1 if "laneId" in segmented.columns else F.lit(False)
    step = F.abs(F.last(y, True).over(span) - F.first(y, True).over(span))
    moved = (F.count(y).over(span) >= 2) & (step > lane_width * 0.5)
    return (lanes | F.coalesce(moved, F.lit(False))).cast("int")


def lane_changes(segmented: DataFrame, shape: Shape = Shape(), lane_width: float = LANE_WIDTH_M) -> DataFrame:
    """source_file, id, start_frame, is_lane_change of every window: another lane id within it, or a side step of over half a lane.

    A window never leaves its sub-track, so its rows are the next ones there and no join is needed.
    """
    changed = segmented.withColumn("is_lane_change", _changed(segmented, shape, lane_width))
    return window_starts(changed, shape).select("source_file", "id", F.col("pos").alias("start_frame"), "is_lane_change")


def index_summary(index: DataFrame, approximate: bool = False) -> DataFrame:
    """Windows, distinct vehicles, (file, vehicle) pairs and files, by data set, by file, and in all; NULL keys mark totals.

    approximate counts distinct values by sketches (5 % standard error), which shuffle a few kilobytes a group.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    sets = index.groupingSets([[F.col("dataset_name")], [F.col("dataset_name"), F.col("source_file")], []], F.col("dataset_name"), F.col("source_file"))
    return sets.agg(F.count("*").alias("windows"), distinct("vehicle_id").alias("vehicle_ids"), distinct(F.struct("source_file", "vehicle_id")).alias("vehicles"), distinct(F.concat("source_file", F.lit(""))).alias("files"))


def recording_summaries(index: DataFrame) -> DataFrame:
    """One row per recording: windows, vehicles, and ids, a sketch of its vehicles' ids. Rows of new recordings are added to a stored table."""
    return index.groupBy("dataset_name", "source_file").agg(F.count("*").alias("windows"), F.count_distinct("vehicle_id").alias("vehicles"), F.hll_sketch_agg("vehicle_id", F.lit(14)).alias("ids"))


def merged_summary(summaries: DataFrame) -> DataFrame:
    """index_summary() from stored recording_summaries(), one row per recording, without reading the index.

    Windows, (file, vehicle) pairs and files are exact, as recordings share none of them. vehicle_ids, which repeat across
    recordings, are estimated from the merged sketches, with a standard error of 0.8 % (2^14 registers).
    """
    sets = summaries.groupingSets([[F.col("dataset_name")], [F.col("dataset_name"), F.col("source_file")], []], F.col("dataset_name"), F.col("source_file"))
    return sets.agg(F.sum("windows").alias("windows"), F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("vehicle_ids"), F.sum("vehicles").alias("vehicles"), F.count("*").alias("files"))


def segment_summary(segmented: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Per recording: sub-tracks, and those too short for a window."""
    per = segmented.groupBy(*KEYS, "segment_id").agg(F.count("*").alias("n"))
    return per.groupBy("source_file").agg(F.count("*").alias("segments"), F.count_if(F.col("n") < shape.length).alias("short_segments"))
