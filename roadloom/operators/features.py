"""The wide feature row of each window, and resuming a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import SLOTS, slot_fields, surroundings
from .windows import Shape, lane_changes

#: The names that readers of the table expect, in order.
FIELDS = ("mask", "id", "x", "y", "vx", "vy", "lane", "ttc", "ttc_valid", "thw", "rel_vx", "rel_vy")
FEATURE_COLUMNS = ("window_id", *(f"{s}_{f}" for s in SLOTS for f in FIELDS), "is_lane_change", "scene_density", "ego_vx_at_hist_end", "ego_vy_at_hist_end", "ego_laneId_at_hist_end")


def wide_features(around: DataFrame) -> DataFrame:
    """FEATURE_COLUMNS from surroundings() of an index that has is_lane_change."""
    ego = F.col("ego")
    return around.select(
        "window_id", *[v.alias(f"{s}_{f}") for s in SLOTS for f, v in slot_fields(s).items()], "is_lane_change", "scene_density",
        ego["xVelocity"].alias("ego_vx_at_hist_end"), ego["yVelocity"].alias("ego_vy_at_hist_end"), ego["laneId"].alias("ego_laneId_at_hist_end"),
    )


def with_lane_changes(index: DataFrame, segmented: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The index with is_lane_change, joined if window_index() has not put it there."""
    if "is_lane_change" in index.columns:
        return index
    changes = lane_changes(segmented, shape).select("source_file", F.col("id").alias("vehicle_id"), "start_frame", "is_lane_change")
    return index.join(changes, ["source_file", "vehicle_id", "start_frame"])


def window_features(index: DataFrame, segmented: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """FEATURE_COLUMNS of every window of the index whose rows are all there."""
    return wide_features(surroundings(with_lane_changes(index, segmented, shape), segmented))


def append_features(index: DataFrame, segmented: DataFrame, path: str, done: DataFrame | None = None, shape: Shape = Shape()) -> None:
    """Writes the features of the index's windows to the table at path, as snappy Parquet of FEATURE_COLUMNS; rows there stay.

    done(window_id) are windows that the table holds already, so that a run which broke off is resumed where it was.
    """
    todo = index if done is None else remaining(index, done)
    window_features(todo, segmented, shape).select(*FEATURE_COLUMNS).write.mode("append").option("compression", "snappy").parquet(path)


def remaining(index: DataFrame, done: DataFrame) -> DataFrame:
    """Windows of the index that a feature table does not hold yet; new rows are appended to it."""
    return index.join(done.select("window_id"), "window_id", "left_anti")


def feature_summary(features: DataFrame, index: DataFrame) -> DataFrame:
    """Per recording: windows, lane changes, mean density, windows with a vehicle in each slot."""
    joined = features.join(index.select("window_id", "source_file"), "window_id")
    return joined.groupBy("source_file").agg(F.count("*").alias("windows"), F.sum("is_lane_change").alias("lane_changes"), F.round(F.avg("scene_density"), 6).alias("mean_density"), *[F.sum(f"{s}_mask").alias(f"{s}_windows") for s in SLOTS])
