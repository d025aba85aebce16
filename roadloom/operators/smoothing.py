"""Savitzky-Golay smoothing of positions, and what it does to velocities and accelerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.savgol import checked_length, weights, window_length
from ..functions.tracks import in_order, step_of, whole_track

FARTHEST = 1e10


def unsafe_reason(c: str) -> Column:
    """Why a track's coordinate must not be smoothed, over the whole track: missing, constant or far values; NULL if none."""
    x, track = F.col(c), whole_track()
    missing = F.count(F.when(x.isNotNull() & ~F.isnan(x), 1)).over(track) < F.count("*").over(track)
    largest, spread = F.max(F.abs(x)).over(track), F.min(x).over(track) == F.max(x).over(track)
    return F.when(missing | (largest == float("inf")), "not_finite").when(spread, "constant").when(largest > FARTHEST, "too_far")


def smooth_positions(tracks: DataFrame, hz: float, seconds: float = 0.3, polyorder: int = 2, length: int | None = None) -> DataFrame:
    """tracks with x_smooth and y_smooth. One shuffle, by (source_file, id).

    The ends take the polynomial fitted to the first or last window. A track shorter than the window uses the longest odd
    window that fits; one of fewer than three rows, and one with an unsafe coordinate, keeps its raw values. Rows count as
    evenly spaced; gaps are split later.
    """
    full = checked_length(length or window_length(hz, seconds, polyorder), polyorder)
    reach = full - 1
    axes, order = ("x", "y"), in_order()
    near = {f"_{c}{k}": (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(order) for c in axes for k in range(-reach, reach + 1) if k}
    rows = tracks.withColumns({"_n": F.count("*").over(whole_track()), "_p": F.row_number().over(in_order()) - 1, "_safe": F.coalesce(unsafe_reason("x"), unsafe_reason("y")).isNull(), **near})

    def smoothed(c: str) -> Column:
        """As SQL text: columns made one by one take thousands of calls to the JVM, which cost more than a small recording's job."""
        out = c
        for size in range(3, full + 1, 2):
            h, table = size // 2, weights(size, polyorder)
            fits = f"_n >= {size}" if size == full else f"(_n = {size} OR _n = {size + 1})"
            value = lambda r: " + ".join(f"{float(table[r][j])!r}D * `{c if j == r else f'_{c}{j - r}'}`" for j in range(size))  # noqa: B023, E731
            inner = value(h)
            for r in range(h):
                inner = f"CASE WHEN _p = {r} THEN {value(r)} WHEN _n - 1 - _p = {r} THEN {value(size - 1 - r)} ELSE {inner} END"
            out = f"CASE WHEN _safe AND {fits} THEN {inner} ELSE {out} END"
        return F.expr(out)

    return rows.withColumns({f"{c}_smooth": smoothed(c) for c in axes}).select(*[F.col(f"`{c}`") for c in tracks.columns if c not in ("x_smooth", "y_smooth")], "x_smooth", "y_smooth")


def track_quality(tracks: DataFrame) -> DataFrame:
    """source_file, reason, tracks: how many tracks are smoothed ('processed'), too short, or unsafe and why."""
    reason = F.when(F.count("*").over(whole_track()) < 3, "too_short").otherwise(F.coalesce(unsafe_reason("x"), unsafe_reason("y"), F.lit("processed")))
    per_track = tracks.select("source_file", "id", reason.alias("reason")).groupBy("source_file", "id").agg(F.first("reason").alias("reason"))
    return per_track.groupBy("source_file", "reason").agg(F.count("*").alias("tracks"))


def smoothing_report(smoothed: DataFrame, hz: float, seconds: float = 0.3, polyorder: int = 2) -> DataFrame:
    """Per recording: standard deviations of velocity and acceleration before and after, reductions, and their class.

    Over tracks of four rows or more whose values are all finite. A mean reduction under 5 % is 'weak', over 50 % 'strong'.
    """
    # pipeline_reduction is the mean over the two velocities, with a floor for the divisor.
    base, after = ("x", "y"), ("x_smooth", "y_smooth")
    fine = F.lit(True)
    for c in (*base, *after):
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = smoothed.withColumn("_ok", F.min(fine.cast("int")).over(whole_track()) == 1).withColumn("_n", F.count("*").over(whole_track())).where("_ok and _n >= 4")
    rate = lambda c: (F.col(c) - F.lag(c).over(in_order())) * float(hz)
    v = kept.withColumns({f"_v{c}": rate(c) for c in (*base, *after)})
    a = v.withColumns({f"_a{c}": rate(f"_v{c}") for c in (*base, *after)})
    names = {"x": "vx_std_before", "x_smooth": "vx_std_after", "y": "vy_std_before", "y_smooth": "vy_std_after"}
    spread = a.groupBy("source_file").agg(
        *[F.stddev_pop(f"_v{c}").alias(n) for c, n in names.items()],
        *[F.stddev_pop(f"_a{c}").alias("a" + n[1:]) for c, n in names.items()],
        F.count_distinct("id").alias("vehicles"),
    )
    drop = lambda q: F.when(F.col(f"{q}_std_before") > 0, (F.col(f"{q}_std_before") - F.col(f"{q}_std_after")) / F.col(f"{q}_std_before")).otherwise(0.0)
    floored = lambda q: 1 - F.col(f"{q}_std_after") / F.greatest(F.col(f"{q}_std_before"), F.lit(1e-8))
    mean = (F.col("vx_reduction") + F.col("vy_reduction") + F.col("ax_reduction") + F.col("ay_reduction")) / 4
    return spread.withColumns({f"{q}_reduction": drop(q) for q in ("vx", "vy", "ax", "ay")}).withColumns({
        "mean_reduction": mean,
        "effect": F.when(mean < 0.05, "weak").when(mean > 0.5, "strong").otherwise("ok"),
        "pipeline_reduction": (floored("vx") + floored("vy")) / 2,
        "window_length": F.lit(window_length(hz, seconds, polyorder)),
    })


def pipeline_info(smoothed: DataFrame, source_hz: float, target_hz: float = 5.0) -> DataFrame:
    """Per recording, what was done to it: rates, rows per kept row, window length, and the reductions of its velocities."""
    report = smoothing_report(smoothed, source_hz)
    return report.select(
        "source_file", F.lit(float(source_hz)).alias("source_freq_hz"), F.lit(float(target_hz)).alias("target_freq_hz"), F.lit(step_of(source_hz, target_hz)).alias("step"),
        "window_length", "vx_reduction", "vy_reduction", "pipeline_reduction", "effect",
    )
