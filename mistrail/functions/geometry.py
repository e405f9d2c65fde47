"""Column expressions on the map: cells, distances, polylines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the map's frame.
MIN_X, MIN_Z, SPAN, GRID = -1.1048965, 32.7558, 14759.455, 512
# Lane polylines and fountains in fractions of the map, x to the right and y down: fixed values.
LANES = {
    "top": [(0.105, 0.795), (0.075, 0.44), (0.10, 0.155), (0.165, 0.095), (0.60, 0.078), (0.80, 0.10)],
    "mid": [(0.175, 0.83), (0.35, 0.655), (0.5, 0.5), (0.655, 0.35), (0.83, 0.175)],
    "bot": [(0.20, 0.895), (0.60, 0.922), (0.80, 0.905), (0.905, 0.835), (0.925, 0.56), (0.90, 0.20)],
}
FOUNTAINS = {0: (0.075, 0.925), 1: (0.925, 0.075)}
# Routes through the jungle of each side, in the same fractions: fixed values.
JUNGLE = {
    0: [(0.10, 0.62), (0.204, 0.516), (0.308, 0.412), (0.332, 0.332), (0.44, 0.44), (0.484, 0.796), (0.588, 0.692), (0.412, 0.63), (0.24, 0.72)],
    1: [(0.90, 0.38), (0.796, 0.484), (0.692, 0.588), (0.668, 0.668), (0.56, 0.56), (0.516, 0.204), (0.412, 0.308), (0.60, 0.37), (0.76, 0.28)],
}
#: Lane of each role; the jungle has its routes.
ROLE_LANES = {"top": "top", "mid": "mid", "bot": "bot", "support": "bot"}


def world(point: tuple[float, float]) -> tuple[float, float]:
    """A point in fractions of the map as world coordinates."""
    return MIN_X + point[0] * SPAN, MIN_Z + (1.0 - point[1]) * SPAN


def cell(value: Column, low: float, grid: int = GRID) -> Column:
    """Cell of a coordinate, by truncation."""
    return ((value - low) / (SPAN / grid)).cast("int")


def distance(x: Column, z: Column, a: Column, b: Column) -> Column:
    return F.sqrt((x - a) * (x - a) + (z - b) * (z - b))


def segments(lane: str) -> list[tuple[float, float, float, float, float, float]]:
    """(x0, z0, x1, z1, arclength before, total arclength) of each segment of a lane."""
    points = [world(p) for p in LANES[lane]]
    lengths = [math.dist(a, b) for a, b in zip(points, points[1:])]
    return [(*a, *b, sum(lengths[:k]), sum(lengths)) for k, (a, b) in enumerate(zip(points, points[1:]))]


def lane_distance(x: Column, z: Column, lane: str) -> Column:
    """Distance to a lane's polyline."""
    parts = []
    for x0, z0, x1, z1, _, _ in segments(lane):
        dx, dz = x1 - x0, z1 - z0
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (z - z0) * dz) / (dx * dx + dz * dz)))
        parts.append(distance(x, z, x0 + f * dx, z0 + f * dz))
    return F.least(*parts)


def lane_fraction(x: Column, z: Column, lane: str) -> Column:
    """Fraction of a lane's length at its point nearest to (x, z)."""
    best = []
    for x0, z0, x1, z1, before, whole in segments(lane):
        dx, dz = x1 - x0, z1 - z0
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (z - z0) * dz) / (dx * dx + dz * dz)))
        best.append(F.struct(distance(x, z, x0 + f * dx, z0 + f * dz).alias("d"), ((before + f * math.hypot(dx, dz)) / whole).alias("s")))
    return F.array_min(F.array(*best))["s"]


def lane_distance_sql(lane: str) -> str:
    parts = []
    for x0, z0, x1, z1, _, _ in segments(lane):
        dx, dz = x1 - x0, z1 - z0
        f = f"greatest(0.0, least(1.0, ((x - {x0!r}) * {dx!r} + (z - {z0!r}) * {dz!r}) / {dx * dx + dz * dz!r}))"
        parts.append(f"sqrt(pow(x - ({x0!r} + {f} * {dx!r}), 2) + pow(z - ({z0!r} + {f} * {dz!r}), 2))")
    return f"least({', '.join(parts)})"


def places_of(role: str | None, team: int) -> list[tuple[float, float]]:
    """Where a hero of this role walks to: the corners of its lane or of the jungle's routes (of all, where the role isn't
    known), and its own fountain."""
    lanes = [ROLE_LANES[role]] if role in ROLE_LANES else [] if role == "jungle" else list(LANES)
    points = [p for lane in lanes for p in LANES[lane]]
    points += [] if role in ROLE_LANES else [p for side in JUNGLE.values() for p in side]
    return [world(p) for p in [*points, FOUNTAINS[team]]]
