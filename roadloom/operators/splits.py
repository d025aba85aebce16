"""Splits of windows along each recording's time, with dead zones, and a check that no two splits share time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")
#: A window's first and last time on the clock by which it was split.
CLOCK = ("clock_start_sec", "clock_end_sec")


def labelled(index: DataFrame, train: float = 0.7, val: float = 0.1, gap_s: float = 8.0, time_basis: str = "track") -> DataFrame:
    """index with split: train, val, test, or gap where a window comes within gap_s / 2 of a cut.

    clock_start_sec and clock_end_sec hold the window's times on the clock that decided, for split_overlap() to check.
    time_basis 'track' takes a window's times within its vehicle's track; 'recording' places the window by anchor_time_sec,
    which window_index(anchor=True) gives: its history's end on the recording's clock. A recording of no length is all train.
    """
    if time_basis not in ("track", "recording"):
        raise ValueError(f"no time basis {time_basis}")
    start, end = CLOCK
    if time_basis == "recording":
        index = with_recording_times(index, start, end)
    else:
        index = index.withColumns({start: F.col("start_time_sec"), end: F.col("end_time_sec")})
    bounds = index.groupBy("source_file").agg(F.min(start).alias("_first"), F.max(end).alias("_last"))
    rows = index.join(bounds, "source_file")
    total, half = F.col("_last") - F.col("_first"), gap_s / 2
    cut1, cut2 = F.col("_first") + total * F.lit(train), F.col("_first") + total * F.lit(train + val)
    center = (F.col(start) + F.col(end)) / 2
    near = lambda cut: (F.col(start) < cut + half) & (F.col(end) > cut - half)
    split = F.when(total <= 0, "train").when(near(cut1) | near(cut2), "gap").when(center > cut2 + half, "test").when((center > cut1 + half) & (center <= cut2 - half), "val").otherwise("train")
    return rows.withColumn("split", split).drop("_first", "_last")


def with_recording_times(index: DataFrame, start: str = "start_time_sec", end: str = "end_time_sec") -> DataFrame:
    """A window's first and last time on the recording's clock, from anchor_time_sec, in the columns start and end."""
    before = (F.col("n_frames_hist") - 1) / F.col("target_freq_hz")
    span = F.col("end_time_sec") - F.col("start_time_sec")
    return index.withColumns({start: F.col("anchor_time_sec") - before, end: F.col("anchor_time_sec") - before + span})


def time_split(index: DataFrame, **params) -> DataFrame:
    """labelled() without the windows in dead zones."""
    return labelled(index, **params).where(F.col("split") != "gap")


def split_summary(kept: DataFrame, index: DataFrame) -> DataFrame:
    """Windows per split, their shares, and what the dead zones took, by recording, data set, and in all (NULL keys)."""
    counts = kept.rollup("dataset_name", "source_file").agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS], F.count("*").alias("kept"))
    before = index.rollup("dataset_name", "source_file").agg(F.count("*").alias("windows"))
    same = before["dataset_name"].eqNullSafe(counts["dataset_name"]) & before["source_file"].eqNullSafe(counts["source_file"])
    both = before.join(counts, same, "left").select(before["dataset_name"], before["source_file"], "windows", *[F.coalesce(s, F.lit(0)).alias(s) for s in (*SPLITS, "kept")])
    return both.select("*", (F.col("windows") - F.col("kept")).alias("dead_zone"), *[F.try_divide(F.col(s), F.col("kept")).alias(f"{s}_share") for s in SPLITS])


def split_overlap(split: DataFrame, slab_s: float = 600.0) -> DataFrame:
    """Per recording and split: distinct intervals, those that overlap another split's in time, and window ids in several splits.

    Times are those of the clock that the split was made by, where it carries them, else the tracks' own. Exact: intervals
    and the moments at which they end are swept in order of time, with the farthest end so far of each split. That end is
    found within slabs of slab_s seconds and, over the slabs before, from one row per slab, so no recording is one task.
    """
    start, end = CLOCK if CLOCK[0] in split.columns else ("start_time_sec", "end_time_sec")
    spans = split.select("source_file", "split", F.col(start).alias("s"), F.col(end).alias("e")).distinct()
    # An interval overlaps another if that one opens before it ends and ends after it starts; at one moment, questions come first.
    moments = F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("opens")), F.struct(F.col("e").alias("t"), F.lit(0).alias("opens"))))
    events = spans.select("source_file", "split", "s", "e", moments.alias("m")).select("source_file", "split", "s", "e", "m.t", "m.opens").withColumn("slab", F.floor(F.col("t") / slab_s))
    ends = {x: F.when((F.col("opens") == 1) & (F.col("split") == x), F.col("e")) for x in SPLITS}
    earlier = Window.partitionBy("source_file").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    slabs = events.groupBy("source_file", "slab").agg(*[F.max(v).alias(f"_{x}") for x, v in ends.items()]).select("source_file", "slab", *[F.max(f"_{x}").over(earlier).alias(f"_before_{x}") for x in SPLITS])
    within = Window.partitionBy("source_file", "slab").orderBy("t", "opens").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.join(slabs, ["source_file", "slab"]).withColumns({f"_{x}": F.greatest(F.max(v).over(within), f"_before_{x}") for x, v in ends.items()})
    hit = F.lit(False)
    for x in SPLITS:
        hit = hit | ((F.col("split") != x) & F.coalesce(F.col(f"_{x}") > F.col("s"), F.lit(False)))
    found = swept.where("opens = 0").groupBy("source_file", "split").agg(F.count("*").alias("intervals"), F.count_if(hit).alias("overlapping"))
    several = split.select("source_file", "window_id", "split").distinct().withColumn("_k", F.count("*").over(Window.partitionBy("source_file", "window_id")))
    shared = several.groupBy("source_file", "split").agg(F.count_if(F.col("_k") > 1).alias("shared_ids"))
    return found.join(shared, ["source_file", "split"])


def assert_no_overlap(split: DataFrame) -> None:
    bad = split_overlap(split).where((F.col("overlapping") > 0) | (F.col("shared_ids") > 0)).limit(5).collect()
    if bad:
        raise ValueError(f"splits share time or windows: {bad}")
