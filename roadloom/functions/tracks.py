"""Column expressions over tracks: windows, gradients, risk."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEYS = ("source_file", "id")

MAX_TTC_S, LANE_TOLERANCE_M, LANE_WIDTH_M, ALONGSIDE_M, NEAR_STILL_MPS = 30.0, 1.8, 3.5, 5.0, 1.0


def whole_track() -> WindowSpec:
    """All rows of a vehicle in one recording; ids repeat across recordings."""
    return Window.partitionBy(*KEYS)


def in_order() -> WindowSpec:
    return whole_track().orderBy("frame")


def position() -> Column:
    """0-based place of a row in its track."""
    return (F.row_number().over(in_order()) - 1).cast("long")


def finite(c: str | Column) -> Column:
    """NaN as NULL; infinities stay, for the safety check to find."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def gradient(c: str, dt: float) -> Column:
    """Central differences inside a track, one-sided at its ends, 0 for a single row."""
    track = f"PARTITION BY {', '.join(KEYS)}"
    before, after, p = (f"{f} OVER ({track} ORDER BY frame)" for f in (f"lag({c})", f"lead({c})", "row_number()"))
    n = f"count(*) OVER ({track})"
    return F.expr(f"CASE WHEN {n} < 2 THEN 0.0D WHEN {p} = 1 THEN ({after} - {c}) / {dt!r}D WHEN {p} = {n} THEN ({c} - {before}) / {dt!r}D ELSE ({after} - {before}) / {2 * dt!r}D END")


def direction(vx: Column) -> Column:
    """1 or -1 by the sign of a velocity; NULL velocity has none."""
    return F.when(vx >= 0, 1).when(vx < 0, -1)


def same_direction(vx: Column, towards: Column) -> Column:
    return F.coalesce((vx * towards >= 0) | (F.abs(vx) < NEAR_STILL_MPS), F.lit(False)) & towards.isNotNull()


def time_to_collision(dx: Column, closing_of_ego: Column) -> Column:
    """Seconds until the rear car meets the front one, NULL if it does not catch up within MAX_TTC_S.

    dx is the other car's place seen from ego; closing_of_ego is ego's speed less the other's.
    """
    gap = F.abs(dx)
    closing = F.when(dx > 0, closing_of_ego).otherwise(-closing_of_ego)
    ttc = F.when((closing > 0) & (gap > 0), F.try_divide(gap, closing))
    return F.when(ttc <= MAX_TTC_S, ttc)


def headway(dx: Column, vx: Column) -> Column:
    return F.abs(dx) / (F.abs(vx) + 1e-6)


def step_of(source_hz: float, target_hz: float) -> int:
    """Rows per kept row; the ratio must be a whole number."""
    ratio = source_hz / target_hz
    if ratio < 1 or abs(ratio - round(ratio)) > 1e-6:
        raise ValueError(f"{source_hz} Hz can't be thinned to {target_hz} Hz: {ratio} is no whole number")
    return round(ratio)
