"""Fixed-shape nested arrays for each window: histories of ego and six neighbours, future, masks, interaction features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.recordings import bucketed, by_size, kept, shuffled
from .neighbors import SLOTS
from .windows import Shape

STATES = "array<array<float>>"


#: Places of a track that begin in one chunk, by default.
CHUNK_ROWS = 256


@dataclass(frozen=True)
class Chunks:
    """Tracks as arrays of bounded length.

    states(_file, _id, _chunk, states) holds the states (x_smooth, y_smooth, xVelocity, yVelocity) at the places from
    _chunk * rows on, in order: `rows` of them and as many more as a window needs that begins at the last, so that a window
    of places lies in one chunk. lengths(_file, _id, _rows) holds the tracks' numbers of rows.
    """

    states: DataFrame
    lengths: DataFrame
    rows: int

    def at(self, wanted: DataFrame, track: str, first: Column, length: Column | int) -> DataFrame:
        """wanted(source_file, the column `track`, ...) with s, the states at `length` places from `first` on, as far as there are any."""
        rows = wanted.withColumns({"_first": first, "_length": F.lit(length) if isinstance(length, int) else length}).withColumn("_chunk", F.floor(F.col("_first") / self.rows))
        states = self.states.select(F.col("_file").alias("source_file"), F.col("_id").alias(track), "_chunk", "states")
        place = (F.col("_first") - F.col("_chunk") * self.rows + 1).cast("int")
        return shuffled(rows).join(states, ["source_file", track, "_chunk"]).withColumn("s", F.slice("states", place, F.col("_length").cast("int"))).drop("states", "_first", "_length", "_chunk")


def track_chunks(tracks: DataFrame, shape: Shape = Shape(), rows: int = CHUNK_ROWS) -> Chunks:
    """The chunks of tracks. A row goes into one chunk or two; no task or row ever holds a whole track."""
    if rows < shape.length:
        raise ValueError(f"a chunk of {rows} places is shorter than a window of {shape.length}")
    state = F.struct("pos", F.array(*[F.col(c).cast("float") for c in ("x_smooth", "y_smooth", "xVelocity", "yVelocity")]).alias("v"))
    own = F.floor(F.col("pos") / rows)
    before = F.when((own > 0) & (F.col("pos") % rows < shape.length - 1), own - 1)
    each = tracks.select(F.col("source_file").alias("_file"), F.col("id").alias("_id"), state.alias("_s"), F.explode(F.array_compact(F.array(own, before))).alias("_chunk"))
    states = each.groupBy("_file", "_id", "_chunk").agg(F.transform(F.sort_array(F.collect_list("_s")), lambda s: s["v"]).alias("states"))
    lengths = tracks.groupBy(F.col("source_file").alias("_file"), F.col("id").alias("_id")).agg((F.max("pos") + 1).alias("_rows"))
    return Chunks(states, lengths, rows)


def kept_chunks(tracks: DataFrame, shape: Shape = Shape(), rows: int = CHUNK_ROWS, buckets: int | None = None) -> Chunks:
    """track_chunks(), written once, for ego and neighbours to read; with buckets, so that neither shuffles a chunk."""
    made = track_chunks(tracks, shape, rows)
    lengths = by_size(kept(made.lengths, "lengths"))
    if buckets is None:
        return Chunks(kept(made.states, "chunks"), lengths, rows)
    return Chunks(bucketed(made.states, "chunks", ["_file", "_id", "_chunk"], buckets), lengths, rows)


def ego_arrays(index: DataFrame, tracks: DataFrame, shape: Shape = Shape(), chunks: Chunks | None = None) -> DataFrame:
    """window_id, ego_hist [15][4], ego_fut [25][2]; windows without all their rows are left out."""
    chunks = chunks or track_chunks(tracks, shape)
    cut = chunks.at(index.select("window_id", "source_file", "vehicle_id", "start_frame"), "vehicle_id", F.col("start_frame"), shape.length).where(F.size("s") == shape.length)
    return cut.select("window_id", F.slice("s", 1, shape.hist).alias("ego_hist"), F.transform(F.slice("s", shape.hist + 1, shape.fut), lambda s: F.slice(s, 1, 2)).alias("ego_fut"))


def neighbor_histories(index: DataFrame, slots: DataFrame, tracks: DataFrame, shape: Shape = Shape(), align: str = "position", chunks: Chunks | None = None) -> DataFrame:
    """window_id, slot_no, hist [15][4] of every filled slot, and f, the values of interaction(), where slots hold them.

    align 'position' takes the neighbour's rows at ego's places in the track, or its last rows if it has fewer than the
    window's end; 'frame' takes the rows whose frames end at ego's anchor. Short histories are padded in front by their first row.
    """
    chunks = chunks or track_chunks(tracks, shape)
    more = [c for c in ("f",) if c in slots.columns]
    filled = slots.where("mask = 1 and id is not null").select("window_id", "slot_no", F.col("id").alias("_nid"), *more)
    wanted = shuffled(filled).join(index.select("window_id", "source_file", "vehicle_id", "start_frame", "end_frame"), "window_id")
    if align == "frame":
        at = tracks.select("source_file", F.col("id").alias("_nid"), F.col("frame").alias("_fr"), F.col("pos").alias("_np"))
        ego = tracks.select("source_file", F.col("id").alias("vehicle_id"), F.col("pos").alias("_ep"), F.col("frame").alias("_fr"))
        wanted = wanted.withColumn("_ep", F.col("start_frame") + shape.hist - 1).join(ego, ["source_file", "vehicle_id", "_ep"]).join(at, ["source_file", "_nid", "_fr"])
        first, length = F.greatest(F.col("_np") - shape.hist + 1, F.lit(0)), F.least(F.col("_np") + 1, F.lit(shape.hist))
    else:
        wanted = wanted.join(chunks.lengths.select(F.col("_file").alias("source_file"), F.col("_id").alias("_nid"), "_rows"), ["source_file", "_nid"])
        first = F.when(F.col("_rows") < F.col("end_frame"), F.greatest(F.col("_rows") - shape.hist, F.lit(0))).otherwise(F.col("start_frame"))
        length = F.lit(shape.hist)
    got = chunks.at(wanted, "_nid", first, length).where(F.size("s") > 0)
    return got.select("window_id", "slot_no", F.concat(F.array_repeat(F.col("s")[0], F.lit(shape.hist) - F.size("s")), "s").alias("hist"), *more)


def interaction(slots: DataFrame) -> DataFrame:
    """window_id, slot_no, f: (ttc, thw, rel_vx, rel_vy, ttc_valid, mask) of every filled slot, NULL as 0."""
    return slots.where("mask = 1").select("window_id", "slot_no", _interaction().alias("f"))


def _interaction() -> Column:
    zero = lambda c: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float"))
    return F.array(*[zero(c) for c in ("ttc", "thw", "rel_vx", "rel_vy", "ttc_valid", "mask")])


def samples(index: DataFrame, slots: DataFrame, features: DataFrame, tracks: DataFrame, shape: Shape = Shape(), normalise: bool = True, zero_masked: bool = False, align: str = "position", chunks: Chunks | None = None) -> DataFrame:
    """One row per window: hist [7][15][4] with ego first, fut [25][2], mask_fixed6, interaction_feats [6][15][6],
    valid_ttc_mask, is_lane_change, scene_density, source_freq.

    normalise moves the origin to ego's last history position and turns ego's velocity onto the x axis. As speeds are
    divided by speed + 1e-6, a standing ego maps every position to 0. Empty slots are zero before that step, and after it
    too with zero_masked. chunks is kept_chunks(tracks), where it has been written before; features need window_id,
    is_lane_change and scene_density only, and windows that they lack have false and 0.
    """
    chunks = chunks or track_chunks(tracks, shape)
    ego = ego_arrays(index, tracks, shape, chunks)
    near = neighbor_histories(index, slots.withColumn("f", _interaction()), tracks, shape, align, chunks)
    per_window = near.groupBy("window_id").agg(F.map_from_entries(F.collect_list(F.struct("slot_no", F.struct("hist", "f")))).alias("m"))
    zeros = lambda n, k: F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), k), n)
    slot = lambda i: F.try_element_at(F.col("m"), F.lit(i))
    rows = shuffled(ego).join(per_window, "window_id", "left").select(
        "window_id", "ego_fut",
        F.array("ego_hist", *[F.coalesce(slot(i)["hist"], zeros(shape.hist, 4)) for i in range(len(SLOTS))]).alias("hist"),
        F.array(*[F.when(slot(i).isNotNull(), 1.0).otherwise(0.0).cast("float") for i in range(len(SLOTS))]).alias("mask_fixed6"),
        F.array(*[F.coalesce(slot(i)["f"], F.array_repeat(F.lit(0.0).cast("float"), 6)) for i in range(len(SLOTS))]).alias("_f"),
    )
    if normalise:
        rows = _normalised(rows, zero_masked, shape)
    extras = features.select("window_id", "is_lane_change", "scene_density")
    joined = rows.join(shuffled(extras), "window_id", "left").join(shuffled(index.select("window_id", "source_freq_hz")), "window_id")
    return joined.select(
        "window_id", F.col("hist").cast("array<array<array<float>>>").alias("hist"), F.col("ego_fut").cast(STATES).alias("fut"), "mask_fixed6",
        F.transform("_f", lambda f: F.array_repeat(f, shape.hist)).alias("interaction_feats"), F.transform("_f", lambda f: f[4]).alias("valid_ttc_mask"),
        (F.coalesce("is_lane_change", F.lit(0)) == 1).alias("is_lane_change"), F.coalesce("scene_density", F.lit(0)).cast("long").alias("scene_density"), F.coalesce("source_freq_hz", F.lit(10.0)).cast("float").alias("source_freq"),
    )


def _normalised(rows: DataFrame, zero_masked: bool, shape: Shape) -> DataFrame:
    last = F.col("hist")[0][shape.hist - 1]
    at = rows.withColumns({n: last[i].cast("double") for i, n in enumerate(("_x0", "_y0", "_vx", "_vy"))})
    speed = F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy")) + 1e-6
    at = at.withColumn("_cos", F.col("_vx") / speed).withColumn("_sin", F.col("_vy") / speed)
    cos, sin = F.col("_cos"), F.col("_sin")

    def turned(x: Column, y: Column) -> list[Column]:
        return [cos * x + sin * y, cos * y - sin * x]

    def state(s):
        return F.array(*turned(s[0].cast("double") - F.col("_x0"), s[1].cast("double") - F.col("_y0")), *turned(s[2].cast("double"), s[3].cast("double"))).cast("array<float>")

    moved = F.transform("hist", lambda h: F.transform(h, state))
    if zero_masked:
        keep = F.concat(F.array(F.lit(1.0).cast("float")), F.col("mask_fixed6"))
        moved = F.zip_with(moved, keep, lambda h, m: F.transform(h, lambda s: F.transform(s, lambda v: v * m)))
    future = F.transform("ego_fut", lambda s: F.array(*turned(s[0].cast("double") - F.col("_x0"), s[1].cast("double") - F.col("_y0"))).cast("array<float>"))
    return at.withColumn("hist", moved).withColumn("ego_fut", future).drop("_x0", "_y0", "_vx", "_vy", "_cos", "_sin")
