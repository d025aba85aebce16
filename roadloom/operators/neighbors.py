"""Neighbours of a window's anchor, its last history row, in six slots, and their risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tracks import ALONGSIDE_M, LANE_TOLERANCE_M, direction, headway, same_direction, time_to_collision
from ..sources.recordings import bucketed, shuffled
from .windows import STATE

SLOTS = tuple(f"{side}_{place}" for side in ("left", "right") for place in ("preceding", "alongside", "following"))


def direction_groups(tracks: DataFrame) -> DataFrame:
    """Per recording and sign of velocity: vehicles, rows, and the group's direction by its median velocity."""
    by_sign = tracks.withColumn("vx_sign", F.when(F.col("xVelocity") >= 0, 1).otherwise(-1))
    return by_sign.groupBy("source_file", "vx_sign").agg(F.count_distinct("id").alias("vehicles"), F.count("*").alias("rows"), F.when(F.percentile("xVelocity", 0.5) >= 0, 1).otherwise(-1).alias("direction"))


def _carried(index: DataFrame) -> list[str]:
    return [c for c in ("is_lane_change",) if c in index.columns]


def anchors(index: DataFrame, tracks: DataFrame) -> DataFrame:
    """window_id and ego's state (e_...) at the window's last history row; windows whose end lies beyond the track have none.

    is_lane_change is carried along where the index has it. An index with ego_at_anchor holds the state already.
    """
    more = _carried(index)
    if "ego_at_anchor" in index.columns:
        e = F.col("ego_at_anchor")
        state = [e["frame"].alias("e_frame"), *[e[c].alias(f"e_{c}") for c in STATE]]
        return index.select("window_id", "source_file", *more, F.col("vehicle_id").alias("e_id"), *state, direction(e["xVelocity"]).alias("e_dir"))
    rows = tracks.select(F.col("source_file").alias("_file"), F.col("id").alias("e_id"), F.col("pos").alias("_pos"), F.col("frame").alias("e_frame"), *[F.col(c).alias(f"e_{c}") for c in STATE])
    place = index.select("window_id", "source_file", "vehicle_id", *more, (F.col("start_frame") + F.col("n_frames_hist") - 1).alias("_at"))
    joined = shuffled(place).join(rows, (F.col("source_file") == F.col("_file")) & (F.col("vehicle_id") == F.col("e_id")) & (F.col("_at") == F.col("_pos")))
    return joined.select("window_id", "source_file", *more, "e_id", "e_frame", *[f"e_{c}" for c in STATE], direction(F.col("e_xVelocity")).alias("e_dir"))


def scenes(index: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each anchor with every vehicle of its recording and frame (o_...), ego among them, and places as seen from ego."""
    others = tracks.select("source_file", F.col("frame").alias("e_frame"), F.col("id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in STATE])
    pairs = shuffled(anchors(index, tracks)).join(others, ["source_file", "e_frame"])
    return pairs.withColumns({
        "dx": (F.col("o_x") - F.col("e_x")) * F.col("e_dir"),
        "dy": (F.col("o_y") - F.col("e_y")) * F.col("e_dir"),
        "same_direction": same_direction(F.col("o_xVelocity"), F.col("e_dir")),
    })


def _nearest(when: Column, distance: Column) -> Column:
    state = F.struct(distance.alias("distance"), F.col("o_id").alias("id"), F.col("o_x").alias("x"), F.col("o_y").alias("y"), F.col("o_xVelocity").alias("vx"), F.col("o_yVelocity").alias("vy"), F.col("o_laneId").alias("lane"), F.col("dx").alias("dx"))
    return F.min(F.when(when, state))


def stored_scenes(tracks: DataFrame, buckets: int) -> DataFrame:
    """tracks with what scenes() needs, stored in buckets by (source_file, frame), so that anchors meet them where they lie."""
    return bucketed(tracks.select("source_file", "frame", "id", *STATE), "scenes", ["source_file", "frame"], buckets)


def surroundings(index: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per window: a struct per slot (NULL if empty), own_lead, scene_density, ego's state, and source_file.

    With an index that has ego_at_anchor, tracks may be stored_scenes(), and no track is shuffled.

    The nearest vehicle of a slot is a conditional minimum, so partial aggregation shrinks the scenes before the shuffle;
    ties of distance fall to the lowest id. Ego without a velocity has no direction, no neighbours and density 0.
    """
    dx, dy = F.col("dx"), F.col("dy")
    other = F.col("same_direction") & (F.col("o_id") != F.col("e_id"))
    sides = {"left": dy < -LANE_TOLERANCE_M, "right": dy > LANE_TOLERANCE_M}
    places = {"preceding": dx > ALONGSIDE_M, "alongside": F.abs(dx) <= ALONGSIDE_M, "following": dx < -ALONGSIDE_M}
    slots = [_nearest(other & sides[s.split("_")[0]] & places[s.split("_")[1]], F.abs(dx)).alias(s) for s in SLOTS]
    ego = F.first(F.struct(*[F.col(f"e_{c}").alias(c) for c in ("id", *STATE, "dir")])).alias("ego")
    more = [F.first(c).alias(c) for c in ("source_file", *_carried(index))]
    density = F.greatest(F.count_if(F.col("same_direction")) - 1, F.lit(0)).cast("int").alias("scene_density")
    lead = _nearest(other & (F.abs(dy) <= LANE_TOLERANCE_M) & (dx > 0), F.abs(dx)).alias("own_lead")
    return scenes(index, tracks).groupBy("window_id").agg(*slots, lead, density, ego, *more)


def slot_fields(slot: str) -> dict[str, Column]:
    """The twelve fields of a slot, from surroundings()."""
    o, e = F.col(slot), F.col("ego")
    out = {"mask": o.isNotNull().cast("int"), **{n: o[n] for n in ("id", "x", "y", "vx", "vy", "lane")}}
    if slot.endswith("preceding"):
        # As the slot's distance is not mirrored by direction there, so it is not here.
        along = o["x"] - e["x"]
        ttc = F.when(F.abs(o["y"] - e["y"]) <= LANE_TOLERANCE_M, time_to_collision(along, (e["xVelocity"] - o["vx"]) * e["dir"]))
        thw = headway(along, e["xVelocity"])
    else:
        ttc = thw = F.lit(None).cast("double")
    return {**out, "ttc": ttc, "ttc_valid": ttc.isNotNull().cast("int"), "thw": F.when(o.isNotNull(), thw), "rel_vx": o["vx"] - e["xVelocity"], "rel_vy": o["vy"] - e["yVelocity"]}


def slot_table(around: DataFrame) -> DataFrame:
    """Six rows per window: window_id, slot_no, slot and the slot's twelve fields."""
    rows = F.array(*[F.struct(F.lit(i).alias("slot_no"), F.lit(s).alias("slot"), *[v.alias(k) for k, v in slot_fields(s).items()]) for i, s in enumerate(SLOTS)])
    return around.select("window_id", F.explode(rows).alias("s")).select("window_id", "s.*")


def own_lane_risk(around: DataFrame) -> DataFrame:
    """Windows with a vehicle ahead in ego's lane: its id, distance, time to collision and headway, seen along ego's direction."""
    o, e = F.col("own_lead"), F.col("ego")
    ttc = time_to_collision(o["dx"], (e["xVelocity"] - o["vx"]) * e["dir"])
    return around.where(o.isNotNull()).select("window_id", o["id"].alias("lead_id"), o["dx"].alias("gap"), ttc.alias("ttc"), ttc.isNotNull().cast("int").alias("ttc_valid"), headway(o["dx"], e["xVelocity"]).alias("thw"))


def window_quality(around: DataFrame, still: float = 1e-3) -> DataFrame:
    """Per recording: windows, those whose ego has no velocity (no direction, no neighbours), and those whose ego stands still.

    A standing ego has no heading, so that normalised samples of its window are all 0.
    """
    vx, vy = F.col("ego")["xVelocity"], F.col("ego")["yVelocity"]
    stands = F.sqrt(vx * vx + F.coalesce(vy, F.lit(0.0)) * F.coalesce(vy, F.lit(0.0))) < still
    return around.groupBy("source_file").agg(F.count("*").alias("windows"), F.count_if(vx.isNull()).alias("without_velocity"), F.count_if(stands).alias("standing"))
