"""Columns of raw recordings under canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names under which recordings hold each column, the first that is there wins.
ALIASES = {
    "id": ("id", "vehicle_id", "Vehicle_ID", "track_id", "trackId"),
    "frame": ("frame", "Frame_ID", "frame_id", "frameId"),
    "timestamp": ("timestamp", "time", "Global_Time", "global_time", "global_time_ms"),
    "x": ("x", "X", "local_x", "Local_X"),
    "y": ("y", "Y", "local_y", "Local_Y"),
    "xVelocity": ("xVelocity", "vx", "v_x"),
    "yVelocity": ("yVelocity", "vy", "v_y"),
    "speed": ("v_Vel", "v_vel", "speed", "velocity", "v_Speed"),
}
KINDS = {"id": "long", "frame": "long"}


def found_column(df: DataFrame, name: str) -> str | None:
    return next((c for c in ALIASES[name] if c in df.columns), None)


def canonical(df: DataFrame) -> DataFrame:
    """df with every known column under its canonical name and type, NaN as NULL; other columns stay.

    Raises ValueError if there is no id, or neither frame nor timestamp.
    """
    found = {name: c for name in ALIASES if (c := found_column(df, name))}
    if "id" not in found:
        raise ValueError(f"no column for id among {df.columns}")
    if "frame" not in found and "timestamp" not in found:
        raise ValueError(f"no column for frame or timestamp among {df.columns}")
    out = []
    for name, c in found.items():
        value = F.col(f"`{c}`").cast(KINDS.get(name, "double"))
        out.append((value if name in KINDS else F.when(~F.isnan(value), value)).alias(name))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in found.values()]
    return df.select(*out, *rest)


def of_dataset(df: DataFrame, name: str | None) -> DataFrame:
    """One data set's rows; partition pruning where it is a partition column. None: all."""
    return df if name is None else df.where(F.col("dataset_name") == name)
