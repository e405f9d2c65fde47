"""A hero's path from anchors, orders, speeds and downs: dead reckoning in order of time."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of events in the order in which they count at one time.
SPEED, ANCHOR, ORDER, DOWN = range(4)
DEFAULT_SPEED, SNAP = 335.0, 1200.0
_OUT = "match_id string, slot int, tick int, x double, z double"
_EVENT = "match_id string, slot int, t double, kind int, value double, x double, z double, path array<struct<x:double,z:double>>"


def _onward(x: float, z: float, path: list[tuple[float, float]], way: float) -> tuple[float, float, list[tuple[float, float]]]:
    """Where ``way`` units along the path lead, and what is left of it."""
    while path and way > 0:
        d = math.dist((x, z), path[0])
        if d > way:
            f = way / d
            return x + (path[0][0] - x) * f, z + (path[0][1] - z) * f, path
        (x, z), path, way = path[0], path[1:], way - d
    return x, z, path


def _join(x: float, z: float, path: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The rest of the path from its point nearest to (x, z)."""
    best, rest = math.inf, path
    for k, (a, b) in enumerate(zip(path, path[1:])):
        dx, dz = b[0] - a[0], b[1] - a[1]
        f = max(0.0, min(1.0, ((x - a[0]) * dx + (z - a[1]) * dz) / ((dx * dx + dz * dz) or 1.0)))
        at = (a[0] + f * dx, a[1] + f * dz)
        if (d := math.dist((x, z), at)) < best:
            best, rest = d, [at, *path[k + 1 :]]
    return rest


def _reckon(events: pd.DataFrame, n_ticks: int) -> list[tuple[int, float, float]]:
    """(tick, x, z) of each tick with a known position; a tick at the time of an event has the state before it."""
    place: tuple[float, float] | None = None
    path: list[tuple[float, float]] = []
    speed, now, out, tick = DEFAULT_SPEED, 0.0, [], 0
    rows = list(events.sort_values(["t", "kind"], kind="stable")[["t", "kind", "value", "x", "z", "path"]].itertuples(index=False))
    for t, kind, value, x, z, way in [*rows, (float(n_ticks), DOWN, None, None, None, None)]:
        while tick < n_ticks and tick <= t:
            if place:
                *place, path = _onward(*place, path, speed * (tick - now))
                place = tuple(place)
                out.append((tick, *place))
            now, tick = float(tick), tick + 1
        if place and t > now:
            *place, path = _onward(*place, path, speed * (t - now))
            place = tuple(place)
        now = max(now, t)
        if kind == SPEED:
            speed = value
        elif kind == ANCHOR:
            # An observation that disagrees with the path means that the path was wrong: it is dropped.
            place, path = (x, z), []
        elif kind == ORDER and len(way):
            points = [(p["x"], p["z"]) for p in way]
            if place is None or math.dist(place, points[0]) <= SNAP:
                place, path = points[0], points[1:]
            elif len(points) > 1:
                place, *path = _join(*place, points)
            else:
                path = []
        elif kind == DOWN:
            place, path = None, []
    return out


def trajectories(events: DataFrame, ticks: DataFrame) -> DataFrame:
    """(match_id, slot, tick, x, z) of every tick at which the position is known.

    ``events``: match_id, slot, t, kind, value (speeds), x, z (anchors), path (orders); ``ticks``: match_id, n_ticks. A
    group is a hero in a match, with rows in proportion to the match's length; its events are followed in order of time,
    speeds before anchors before orders before downs. An anchor sets the position and ends the way ahead, an order sets the
    way: one that starts within SNAP is taken up at its start, any other at its nearest point.

    Defined results: events without time, kind or (where their kind needs it) value are left out; matches without
    n_ticks give nothing; before the first anchor or order and after a down there is no position.
    """
    good = (F.col("kind") == SPEED) & (F.col("value") > 0) | (F.col("kind") == ANCHOR) & F.col("x").isNotNull() & F.col("z").isNotNull() | (F.col("kind") == ORDER) & (F.array_size("path") > 0) | (F.col("kind") == DOWN)
    rows = events.filter(F.col("t").isNotNull() & ~F.isnan("t") & good).join(ticks.filter("n_ticks > 0").groupBy("match_id").agg(F.max("n_ticks").alias("n_ticks")), "match_id")

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        found = _reckon(frame, int(frame["n_ticks"].iloc[0]))
        return pd.DataFrame([(frame["match_id"].iloc[0], int(frame["slot"].iloc[0]), *f) for f in found], columns=["match_id", "slot", "tick", "x", "z"])

    return rows.groupBy("match_id", "slot").applyInPandas(follow, _OUT)
