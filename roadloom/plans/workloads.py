"""The three workloads end to end: tracks to windows, windows to features, features to samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, frequency, neighbors, resample, samples, smoothing, splits, windows
from ..operators import rates as plans
from ..operators.windows import Shape
from ..sources.recordings import kept, shuffled

def processed_tracks(tracks: DataFrame, source_hz: float, shape: Shape = Shape()) -> DataFrame:
    """Smoothed, thinned to the shape's rate, with recomputed kinematics and sub-tracks. One shuffle, by (source_file, id)."""
    smooth = smoothing.smooth_positions(tracks, source_hz)
    thin = resample.downsample(smooth, source_hz, shape.hz)
    return windows.segments(resample.standardised(resample.kinematics(thin, shape.hz)))


def recording_rates(tracks: DataFrame, rates: DataFrame | None = None, shape: Shape = Shape()) -> DataFrame:
    """rates.rate_plan() of every recording of tracks, written once: how it will be smoothed and thinned, or why it can't be.

    rates(source_file, source_freq_hz) gives each recording's rate; without it, it is detected from the recording's rows. A
    recording that rates lacks, or whose rate can't be told, has the problem no_rate.
    """
    if rates is None:
        found = frequency.rate_report(tracks)
        rates = found.select("source_file", F.coalesce("known_freq_hz", "detected_freq_hz").alias("source_freq_hz"))
    there = tracks.select("source_file").distinct()
    return kept(plans.rate_plan(there.join(rates.select("source_file", "source_freq_hz"), "source_file", "left"), shape.hz), "rates")


def processed_recordings(tracks: DataFrame, rates: DataFrame | None = None, shape: Shape = Shape(), plan: DataFrame | None = None) -> DataFrame:
    """Tracks of recordings of different rates and columns as one table, with source_freq_hz and standard kinematics.

    plan is recording_rates(), made here if not given; recordings with a problem in it are left out, so ask it which these
    are. ValueError if none is left. One scan of the tracks and one shuffle by (source_file, id), whatever the rates.
    """
    plan = recording_rates(tracks, rates, shape) if plan is None else plan
    thin = plans.smoothed_and_thinned(tracks, plan)
    return windows.segments(plans.standardised_by_track(resample.kinematics(thin, shape.hz)))


def tracks_to_windows(tracks: DataFrame, source_hz: float, shape: Shape = Shape()) -> tuple[DataFrame, DataFrame]:
    processed = processed_tracks(tracks, source_hz, shape)
    return processed, windows.window_index(processed, source_hz, shape)


def windows_to_features(index: DataFrame, processed: DataFrame, done: DataFrame | None = None) -> DataFrame:
    todo = features.remaining(index, done) if done is not None else index
    return features.window_features(todo, processed)


def split_windows(index: DataFrame, check: bool = True, **params) -> DataFrame:
    """splits.time_split(), written once, after a check on its own clock that no two splits share time or windows (ValueError)."""
    split = kept(splits.time_split(index, **params), "split")
    if check:
        splits.assert_no_overlap(split)
    return split


def features_to_samples(index: DataFrame, processed: DataFrame, shape: Shape = Shape(), time_basis: str = "track", **params) -> DataFrame:
    """Samples with their split; windows in dead zones are left out. The split is checked for overlaps first.

    time_basis is that of splits.labelled(). Surroundings and track arrays are written once, as slots, features and both
    kinds of histories read them.
    """
    split = features.with_lane_changes(split_windows(index, time_basis=time_basis), processed, shape)
    around = kept(neighbors.surroundings(split, processed), "surroundings")
    chunks = samples.kept_chunks(processed, shape)
    made = samples.samples(split, neighbors.slot_table(around), around, processed, shape, chunks=chunks, **params)
    return made.join(shuffled(split.select("window_id", "split")), "window_id")
