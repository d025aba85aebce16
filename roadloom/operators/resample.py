"""Downsampling to the target rate and velocities and accelerations from smoothed positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tracks import KEYS, gradient, position, step_of


def downsample(tracks: DataFrame, source_hz: float, target_hz: float = 5.0) -> DataFrame:
    """Every N-th row of each track by its place in the track, from the first on, with pos, its place among those kept.

    Positions must have been smoothed before, since thinning first would fold noise into the kept rows.
    """
    if missing := {"x_smooth", "y_smooth"} - set(tracks.columns):
        raise ValueError(f"smooth positions before thinning: {sorted(missing)} are not there")
    n = step_of(source_hz, target_hz)
    return tracks.withColumn("_p", position()).where(F.col("_p") % n == 0).withColumn("pos", F.floor(F.col("_p") / n).cast("long")).drop("_p")


def downsample_report(tracks: DataFrame, source_hz: float, target_hz: float = 5.0) -> DataFrame:
    """Per recording: rows in and out, their ratio, and tracks that keep fewer than two rows."""
    n = step_of(source_hz, target_hz)
    per_track = tracks.groupBy(*KEYS).agg(F.count("*").alias("rows_in")).withColumn("rows_out", F.ceil(F.col("rows_in") / n).cast("long"))
    return per_track.groupBy("source_file").agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"), F.count_if(F.col("rows_out") < 2).alias("short_tracks")).withColumn("keep_ratio", F.col("rows_out") / F.col("rows_in"))


def kinematics(tracks: DataFrame, target_hz: float = 5.0) -> DataFrame:
    """tracks with vx/vy_recomputed and ax/ay_recomputed, the gradients of smoothed positions and of those velocities."""
    dt = 1.0 / target_hz
    v = tracks.withColumns({f"v{c}_recomputed": gradient(f"{c}_smooth", dt) for c in "xy"})
    return v.withColumns({f"a{c}_recomputed": gradient(f"v{c}_recomputed", dt) for c in "xy"})


def standardised(tracks: DataFrame) -> DataFrame:
    """Velocity and acceleration columns always there: where the x column lacks, both are the recomputed ones."""
    for name, made in (("Velocity", "v"), ("Acceleration", "a")):
        if f"x{name}" not in tracks.columns:
            tracks = tracks.withColumns({f"{c}{name}": F.col(f"{made}{c}_recomputed") for c in "xy"})
    return tracks


def aligned(parts: list[DataFrame]) -> DataFrame:
    """Standardised tracks of several recordings of different columns as one, gaps filled from the recomputed columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.withColumns({f"{c}{name}": F.coalesce(F.col(f"{c}{name}"), F.col(f"{made}{c}_recomputed")) for name, made in (("Velocity", "v"), ("Acceleration", "a")) for c in "xy"})
