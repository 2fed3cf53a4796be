"""Three-vectors as structs <x, y, z>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def minus(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scaled(a: Column, k: Column) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def unit_bound(x: Column) -> Column:
    """Held to [-1, 1], for acos and asin."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def angle_deg(a: Column, b: Column) -> Column:
    return F.degrees(F.acos(unit_bound(dot(a, b) / (norm(a) * norm(b)))))
