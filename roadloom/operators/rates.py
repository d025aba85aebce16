"""Smoothing and thinning of recordings of any number of rates in one plan: the rate is a column, filter weights are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.savgol import weights
from ..functions.tracks import in_order, position, whole_track
from ..sources.recordings import joined_by_size, kept
from .smoothing import unsafe_reason

#: Rows of the longest smoothing window. Tables of weights up to it have about 6,000 rows and are broadcast.
LONGEST = 151


def window_rows(hz: Column, seconds: float = 0.3, polyorder: int = 2) -> Column:
    """functions.savgol.window_length() of a column: seconds * hz rounded half to even, made odd, long enough for the polynomial."""
    n = F.rint(hz * seconds).cast("long")
    least = polyorder + 3
    least += least % 2 == 0
    return F.greatest(n + F.when(n % 2 == 0, 1).otherwise(0), F.lit(least))


def rate_plan(rates: DataFrame, target_hz: float = 5.0, seconds: float = 0.3, polyorder: int = 2, longest: int = LONGEST) -> DataFrame:
    """source_file, source_freq_hz, step, length, problem of rates(source_file, source_freq_hz): what is done to each recording.

    problem is NULL where all is well, else no_rate, several_rates (the table gives a recording more than one),
    no_whole_step (the rate is no whole multiple of the target) or window_too_long (over `longest` rows of smoothing).
    """
    per = rates.groupBy("source_file").agg(F.max("source_freq_hz").cast("double").alias("source_freq_hz"), F.count_distinct("source_freq_hz").alias("_rates"))
    hz = F.col("source_freq_hz")
    ratio = hz / target_hz
    whole = (ratio >= 1) & (F.abs(ratio - F.rint(ratio)) <= 1e-6)
    length = window_rows(hz, seconds, polyorder)
    usable = hz.isNotNull() & ~F.isnan(hz) & (hz > 0)
    problem = F.when(~usable, "no_rate").when(F.col("_rates") > 1, "several_rates").when(~whole, "no_whole_step").when(length > longest, "window_too_long")
    fine = problem.isNull()
    return per.select("source_file", hz, F.when(fine, F.rint(ratio).cast("int")).alias("step"), F.when(fine, length.cast("int")).alias("length"), problem.alias("problem"))


def weight_rows(spark: SparkSession, longest: int, polyorder: int = 2) -> DataFrame:
    """_size, _place, _w: the weights of a window of each odd size in the fitted value at each of its places."""
    rows = [(size, place, [float(v) for v in w]) for size in range(3, longest + 1, 2) for place, w in enumerate(weights(size, polyorder))]
    return spark.createDataFrame(rows, "_size int, _place int, _w array<double>")


def smoothed_and_thinned(tracks: DataFrame, plan: DataFrame, polyorder: int = 2) -> DataFrame:
    """tracks of the recordings of a written plan without problem: x_smooth, y_smooth, source_freq_hz, and pos, of every step-th row.

    Rules are those of smooth_positions() and downsample(), with each recording's own window and step. One scan of the
    tracks and one shuffle, by (source_file, id), whatever the number of rates: values around a row are gathered over a
    window frame and multiplied with the row of weights for the window's size and the row's place in it.
    """
    spark = tracks.sparkSession
    fine = plan.where("problem is null").select("source_file", "source_freq_hz", "step", "length")
    longest = fine.agg(F.max("length")).first()[0]
    if longest is None:
        raise ValueError("no recording has a rate that can be thinned")
    reach = longest - 1
    rows = joined_by_size(tracks.drop("source_freq_hz", "step", "length", "x_smooth", "y_smooth", "pos"), fine, ["source_file"])
    near = F.collect_list(F.struct(F.col("x"), F.col("y"))).over(in_order().rowsBetween(-reach, reach))
    safe = F.coalesce(unsafe_reason("x"), unsafe_reason("y")).isNull()
    rows = rows.withColumns({"_n": F.count("*").over(whole_track()), "_p": position(), "_safe": safe, "_near": near}).where(F.col("_p") % F.col("step") == 0)
    n, p = F.col("_n"), F.col("_p")
    size = F.when(n >= F.col("length"), F.col("length")).otherwise(n - 1 + n % 2).cast("int")
    half = F.floor(F.col("_size") / 2)
    center = F.least(F.greatest(p, half), n - 1 - half)
    rows = rows.withColumn("_size", size).withColumn("_place", (p - center + half).cast("int"))
    # No row of weights for windows under three rows, whose tracks stay as they are.
    rows = rows.join(F.broadcast(weight_rows(spark, longest, polyorder)), ["_size", "_place"], "left")
    first = (center - half - F.greatest(p - reach, F.lit(0)) + 1).cast("int")
    window = F.when(F.col("_safe") & F.col("_w").isNotNull(), F.slice("_near", first, F.col("_size")))

    def smoothed(axis: str) -> Column:
        products = F.zip_with("_window", "_w", lambda s, w: s[axis] * w)
        return F.when(F.col("_window").isNotNull(), F.aggregate(products, F.lit(0.0), lambda a, b: a + b)).otherwise(F.col(axis))

    out = rows.withColumn("_window", window).withColumns({"x_smooth": smoothed("x"), "y_smooth": smoothed("y"), "pos": F.floor(p / F.col("step")).cast("long")})
    kept_columns = [c for c in tracks.columns if c not in ("source_freq_hz", "step", "length", "x_smooth", "y_smooth", "pos")]
    return out.select(*[F.col(f"`{c}`") for c in kept_columns], "x_smooth", "y_smooth", "source_freq_hz", "pos")


def standardised_by_track(tracks: DataFrame) -> DataFrame:
    """xVelocity, yVelocity, xAcceleration, yAcceleration of every row: a track whose x column is empty takes the recomputed ones in both axes."""
    for name, made in (("Velocity", "v"), ("Acceleration", "a")):
        own = {c: F.col(f"{c}{name}") if f"{c}{name}" in tracks.columns else F.lit(None).cast("double") for c in "xy"}
        lacks = F.count(own["x"]).over(whole_track()) == 0
        tracks = tracks.withColumns({f"{c}{name}": F.when(lacks, F.col(f"{made}{c}_recomputed")).otherwise(own[c]) for c in "xy"})
    return tracks
