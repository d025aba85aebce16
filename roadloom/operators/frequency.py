"""Sampling rates of recordings, from frames, timestamps, or positions and velocities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tracks import KEYS
from ..sources.recordings import joined_by_size, kept
from .medians import exact_medians

#: Candidate rates in Hz, and rates that recordings are known to have.
CANDIDATES, KNOWN = (10.0, 25.0, 30.0, 50.0), (10.0, 25.0)


def sampled(tracks: DataFrame, vehicles: int | None = None, seed: int = 42) -> DataFrame:
    """All tracks, or those of a fixed sample of so many vehicles of each recording: the least by a hash of the id.

    Each task passes on that many ids of a recording at most; what comes back to the tracks is one bound per recording.
    """
    if vehicles is None:
        return tracks
    hashed = F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("id"))
    first = Window.partitionBy("source_file").orderBy("_h")
    ids = tracks.select(*KEYS).distinct().select("source_file", hashed.alias("_h"))
    bounds = ids.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= vehicles).groupBy("source_file").agg(F.max("_h").alias("_last"))
    return joined_by_size(tracks, kept(bounds, "sample"), ["source_file"]).where(hashed <= F.col("_last")).drop("_last")


def steps(tracks: DataFrame, *columns: str, order: str = "frame") -> DataFrame:
    """Gap to the row before in the same track, and the row before's values of the columns as <name>_before."""
    by = Window.partitionBy(*KEYS).orderBy(order)
    before = [F.lag(c).over(by).alias(f"{c}_before") for c in columns]
    return tracks.select(*KEYS, *dict.fromkeys((order, *columns)), (F.col(order) - F.lag(order).over(by)).alias("gap"), *before).where("gap is not null")


def _ranked(gaps: DataFrame) -> DataFrame:
    counts = gaps.groupBy("source_file", "gap").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source_file").orderBy(F.col("n").desc(), "gap")
    return counts.select("*", F.row_number().over(order).alias("rank"), F.sum("n").over(Window.partitionBy("source_file")).alias("samples"))


def gap_histogram(tracks: DataFrame, top: int = 10) -> DataFrame:
    """source_file, gap, n, rank, share: the commonest frame gaps of each recording, ties to the smaller gap."""
    return _ranked(steps(tracks)).where(F.col("rank") <= top).select("source_file", "gap", "n", "rank", (F.col("n") / F.col("samples")).alias("share"))


def mode_gaps(tracks: DataFrame, top: int = 10) -> DataFrame:
    """One row per recording: mode_gap, confidence (its share), samples, gap_distribution (map of the commonest gaps)."""
    return _modes(_ranked(steps(tracks)), top)


def _modes(ranked: DataFrame, top: int = 10) -> DataFrame:
    held = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("rank") <= top, F.struct("gap", "n")))))
    return ranked.groupBy("source_file").agg(F.min(F.when(F.col("rank") == 1, F.col("gap"))).alias("mode_gap"), F.max(F.when(F.col("rank") == 1, F.col("n") / F.col("samples"))).alias("confidence"), F.first("samples").alias("samples"), held.alias("gap_distribution"))


def _to_seconds(gap: Column) -> Column:
    """Gaps of 1 or more are milliseconds; gaps that are not positive have no unit."""
    return F.when(gap >= 1, gap / 1000).when(gap > 0, gap)


def _of_timestamps(modes: DataFrame, medians: DataFrame) -> DataFrame:
    """Rates of modes(source_file, mode_gap, confidence) from medians(source_file, median), the time of the commonest frame gap."""
    rows = modes.join(medians.select("source_file", F.col("median").alias("_dt")), "source_file", "left")
    per_frame = _to_seconds(F.col("_dt") / F.greatest("mode_gap", F.lit(1)))
    rated = rows.withColumn("detected_freq_hz", F.bround(F.try_divide(F.lit(1.0), per_frame), 2))
    return rated.select("source_file", "mode_gap", "confidence", "detected_freq_hz", F.try_divide(F.lit(1.0), "detected_freq_hz").alias("dt_seconds"), F.coalesce(F.col("_dt") <= 0, F.lit(False)).alias("bad_times"))


def rate_from_timestamp(tracks: DataFrame, time: str = "timestamp") -> DataFrame:
    """source_file, mode_gap, confidence, detected_freq_hz, dt_seconds, by the median time of the commonest frame gap.

    bad_times tells recordings whose times do not rise, which have no rate, from those that hold none.
    """
    gaps = kept(steps(tracks, time).select("source_file", "gap", (F.col(time) - F.col(f"{time}_before")).alias("dt")), "steps")
    modes = kept(_modes(_ranked(gaps)).select("source_file", "mode_gap", "confidence"), "modes")
    pairs = joined_by_size(gaps, modes, ["source_file"]).where(F.col("gap") == F.col("mode_gap"))
    return _of_timestamps(modes, exact_medians(pairs, ["source_file"], "dt"))


def rate_from_timestamp_only(tracks: DataFrame, time: str = "timestamp") -> DataFrame:
    """As above where there are no frames: the commonest gap in whole milliseconds; mode_gap is -1."""
    gaps = kept(steps(tracks, order=time).select("source_file", "gap"), "steps")
    return _of_times_only(gaps, exact_medians(gaps, ["source_file"], "gap"))


def _of_times_only(gaps: DataFrame, medians: DataFrame) -> DataFrame:
    unit = kept(medians.select("source_file", F.col("median").alias("_median")), "units")
    scale = F.when(F.col("_median") >= 1, 0.001).when(F.col("_median") > 0, 1.0)
    whole = joined_by_size(gaps, unit, ["source_file"]).select("source_file", F.rint(F.col("gap") * scale * 1000).cast("long").alias("gap"))
    best = _ranked(whole).where("rank = 1")
    dt = F.col("gap") / 1000
    return best.select("source_file", F.lit(-1).cast("long").alias("mode_gap"), (F.col("n") / F.col("samples")).alias("confidence"), F.when(dt > 0, F.bround(F.try_divide(F.lit(1.0), dt), 2)).alias("detected_freq_hz"), dt.alias("dt_seconds"))


def _ratios(pairs: DataFrame, candidates: tuple[float, ...]) -> DataFrame:
    """source_file, freq_hz, ratio, off of pairs(source_file, mode_gap, dx, v) that move, one row per candidate; finite ratios only."""
    tried = pairs.where(F.abs("v") > 1.0).withColumn("freq_hz", F.explode(F.array(*map(F.lit, candidates))))
    found = tried.withColumn("ratio", F.col("dx") * F.col("freq_hz") / F.col("mode_gap") / F.col("v"))
    found = found.where(F.col("ratio").isNotNull() & ~F.isnan("ratio") & (F.abs("ratio") < float("inf")))
    return found.select("source_file", "freq_hz", "ratio", F.abs(F.log(F.abs("ratio") + 1e-8)).alias("off"))


def velocity_candidates(tracks: DataFrame, velocity: str = "xVelocity", candidates: tuple[float, ...] = CANDIDATES) -> DataFrame:
    """source_file, freq_hz, samples, median_ratio, residual: how well each rate turns steps in x into the stored velocity."""
    v = (F.col(f"{velocity}_before") + F.col(velocity)) / 2
    gaps = kept(steps(tracks, "x", velocity).select("source_file", "gap", (F.col("x") - F.col("x_before")).alias("dx"), v.alias("v")), "steps")
    modes = kept(_modes(_ranked(gaps)).select("source_file", "mode_gap"), "modes")
    ratios = kept(_ratios(joined_by_size(gaps, modes, ["source_file"]).where(F.col("gap") == F.col("mode_gap")), candidates), "ratios")
    keys = ["source_file", "freq_hz"]
    middle = exact_medians(ratios, keys, "ratio").withColumnRenamed("median", "median_ratio")
    return middle.join(exact_medians(ratios, keys, "off").select(*keys, F.col("median").alias("residual")), keys).select(*keys, F.col("n").alias("samples"), "median_ratio", "residual")


def _of_residuals(found: DataFrame) -> DataFrame:
    """The candidate of least residual of found(source_file, freq_hz, samples, residual); ties to the lower rate."""
    order = Window.partitionBy("source_file").orderBy("residual", "freq_hz")
    ranked = found.select("*", F.row_number().over(order).alias("rank"), F.lead("residual").over(order).alias("second"))
    second = F.greatest(F.coalesce("second", F.col("residual") + 1e-6), F.lit(1e-8))
    sure = F.greatest(F.least(1 - F.col("residual") / second, F.lit(1.0)), F.lit(0.0))
    return ranked.where("rank = 1").select("source_file", F.col("freq_hz").alias("detected_freq_hz"), "residual", sure.alias("confidence"), "samples", (F.col("samples") < 100).alias("too_few"))


def rate_from_velocity(tracks: DataFrame, velocity: str = "xVelocity") -> DataFrame:
    """source_file, detected_freq_hz, residual, confidence, samples, too_few: the candidate of least residual."""
    return _of_residuals(velocity_candidates(tracks, velocity))


def step_evidence(tracks: DataFrame) -> DataFrame:
    """source_file, gap, dt, dx, vx, speed of each step of a track: all that the three ways of telling a rate need, in one shuffle.

    Columns that the table lacks count as NULL. A track goes by its frames, rows without one by their times.
    """
    has = lambda c, kind="double": (F.col(c) if c in tracks.columns else F.lit(None)).cast(kind).alias(c)
    rows = tracks.select(*KEYS, has("frame", "long"), has("timestamp"), has("x"), has("xVelocity"), has("speed"))
    by = Window.partitionBy(*KEYS).orderBy(F.coalesce(F.col("frame").cast("double"), "timestamp"), "timestamp")
    before = lambda c: F.lag(c).over(by)
    mean = lambda c: ((F.col(c) + before(c)) / 2).alias(c)
    made = rows.select("source_file", (F.col("frame") - before("frame")).alias("gap"), (F.col("timestamp") - before("timestamp")).alias("dt"), (F.col("x") - before("x")).alias("dx"), mean("xVelocity"), mean("speed"), F.row_number().over(by).alias("_p"))
    return made.where("_p > 1").drop("_p")


def rate_methods(evidence: DataFrame) -> DataFrame:
    """One row per recording of step_evidence(): its commonest gap, that gap's share, and the best way that its own rows allow.

    Frames and times, else times alone, else frames, places and velocities (the speed where a recording has no velocity at
    all), else none. What other recordings of the table hold does not matter.
    """
    gaps = evidence.groupBy("source_file", "gap").agg(F.count("*").alias("n"), F.count("dt").alias("times"), F.count_if(F.col("dx").isNotNull() & F.col("xVelocity").isNotNull()).alias("velocities"), F.count_if(F.col("dx").isNotNull() & F.col("speed").isNotNull()).alias("speeds"))
    framed = F.when(F.col("gap").isNotNull(), F.col("n"))
    best = F.max(F.when(F.col("gap").isNotNull(), F.struct("n", (-F.col("gap")).alias("minus"))))
    per = gaps.groupBy("source_file").agg(best.alias("best"), F.sum(framed).alias("samples"), *[F.sum(c).alias(c) for c in ("times", "velocities", "speeds")])
    has_frames = F.col("best").isNotNull()
    way = F.when(has_frames & (F.col("times") > 0), "frames_and_times").when(F.col("times") > 0, "times").when(has_frames & (F.col("velocities") > 0), "xVelocity").when(has_frames & (F.col("speeds") > 0), "speed").otherwise("none")
    return per.select("source_file", way.alias("way"), (-F.col("best")["minus"]).alias("mode_gap"), F.try_divide(F.col("best")["n"], F.col("samples")).alias("confidence"))


#: What a report calls each way.
METHODS = {"frames_and_times": "timestamp_column", "times": "timestamp_column", "xVelocity": "velocity_consistency", "speed": "velocity_consistency", "none": "frame_column"}


def rate_report(tracks: DataFrame, vehicles: int | None = None, candidates: tuple[float, ...] = CANDIDATES) -> DataFrame:
    """source_file, method, detected_freq_hz, confidence, low_confidence, known_freq_hz, mode_gap: one row per recording with two rows of one track.

    Each recording goes by the best way that its own rows allow, so recordings with times, with velocities only, and with
    neither can stand in one table. Without evidence the rate is NULL, and low_confidence is true wherever the rate is NULL.
    """
    evidence = kept(step_evidence(sampled(tracks, vehicles)), "evidence")
    methods = kept(rate_methods(evidence), "methods")
    rows = joined_by_size(evidence, methods, ["source_file"])
    at_mode = F.col("gap") == F.col("mode_gap")

    timed, untimed = methods.where("way = 'frames_and_times'"), methods.where("way = 'times'")
    dt = rows.where((F.col("way") == "frames_and_times") & at_mode | (F.col("way") == "times")).select("source_file", "dt")
    medians = kept(exact_medians(dt, ["source_file"], "dt"), "medians")
    by_times = _of_timestamps(timed.select("source_file", "mode_gap", "confidence"), medians).select("source_file", "detected_freq_hz", "confidence")
    alone = rows.where("way = 'times'").select("source_file", F.col("dt").alias("gap"))
    by_times_only = _of_times_only(alone, medians.join(untimed.select("source_file"), "source_file", "left_semi")).select("source_file", "detected_freq_hz", "confidence")

    v = F.when(F.col("way") == "xVelocity", F.col("xVelocity")).when(F.col("way") == "speed", F.col("speed"))
    ratios = kept(_ratios(rows.where(at_mode & v.isNotNull()).select("source_file", "mode_gap", "dx", v.alias("v")), candidates), "ratios")
    off = exact_medians(ratios, ["source_file", "freq_hz"], "off").select("source_file", "freq_hz", F.col("n").alias("samples"), F.col("median").alias("residual"))
    by_velocity = _of_residuals(off).select("source_file", "detected_freq_hz", "confidence")

    found = by_times.unionByName(by_times_only).unionByName(by_velocity)
    out = methods.withColumnRenamed("confidence", "_share").join(found, "source_file", "left")
    name = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])[F.col("way")]
    # A recording that is told by its velocities, but has none that moves, is not told at all.
    sure = F.when(F.col("way").isin("xVelocity", "speed"), F.col("confidence")).otherwise(F.coalesce("confidence", "_share"))
    known = F.lit(None).cast("double")
    for hz in KNOWN:
        known = F.when(F.abs(F.col("detected_freq_hz") - hz) < 0.5, hz).otherwise(known)
    low = F.coalesce(sure < 0.8, F.lit(True)) | F.col("detected_freq_hz").isNull()
    return out.select("source_file", name.alias("method"), "detected_freq_hz", sure.alias("confidence"), low.alias("low_confidence"), known.alias("known_freq_hz"), F.coalesce("mode_gap", F.lit(-1)).alias("mode_gap"))
