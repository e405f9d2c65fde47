"""Queries on paths that are reckoned from events (D8), waves on lanes (E12), and beliefs held against them (J10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mistrail.functions.filtering import LATTICE, BeliefModel
from mistrail.functions.geometry import LANES, distance, segments
from mistrail.operators.belief import Reading
from mistrail.operators.structures import place_on
from mistrail.operators.trajectory import ANCHOR, DOWN, ORDER, SPEED, trajectories
from mistrail.plans import base
from mistrail.plans.belief_queries import BIN, believed, true_bins
from mistrail.plans.packet_log import attribute_values, waypoints
from mistrail.plans.resolution import FIRST_WAVE, WAVE_EVERY, WAVE_SPEED, d6_joint_owners, downs
from mistrail.sources.tables import table

#: Seconds that a wave is followed for, and ticks from one position to the next.
WAVE_LIFE, WAVE_STEP = 55, 1


def path_events(spark: SparkSession, data_dir: str) -> DataFrame:
    """Speeds, anchors, owned orders and downs of the heroes, in one shape."""
    none = lambda kind: F.lit(None).cast(kind)
    route = "array<struct<x:double,z:double>>"
    shape = lambda df, kind, value=None, x=None, z=None, path=None: df.select(
        "match_id", "slot", "t", F.lit(kind).alias("kind"), (F.col(value) if value else none("double")).alias("value"), (F.col(x) if x else none("double")).alias("x"), (F.col(z) if z else none("double")).alias("z"), (F.col(path) if path else none(route)).alias("path")
    )
    points = waypoints(spark, data_dir).groupBy("match_id", "line_id", "event_no").agg(F.array_sort(F.collect_list(F.struct("point_no", "x", "z"))).alias("points"))
    routes = points.select("match_id", "line_id", "event_no", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z"))).alias("path"))
    orders = d6_joint_owners(spark, data_dir).select("match_id", "line_id", "event_no", "t", "slot").join(routes, ["match_id", "line_id", "event_no"])
    speeds = attribute_values(spark, data_dir, "mMoveSpeed").filter("value BETWEEN 200 AND 1200")
    events = shape(speeds, SPEED, value="value").unionByName(shape(base.anchors(spark, data_dir), ANCHOR, x="x", z="z"))
    return events.unionByName(shape(orders, ORDER, path="path")).unionByName(shape(downs(spark, data_dir), DOWN))


def d8_trajectories(spark: SparkSession, data_dir: str) -> DataFrame:
    """Positions reckoned from anchors, orders, speeds and downs."""
    found = trajectories(path_events(spark, data_dir), table(spark, data_dir, "matches", "match_id", "n_ticks"))
    return found.select("match_id", "slot", "tick", F.round("x", 3).alias("x"), F.round("z", 3).alias("z"))


def d8_reckoning_error(spark: SparkSession, data_dir: str) -> DataFrame:
    """Distance of the reckoned positions from the given trajectory, per match."""
    given = base.positions(spark, data_dir).select("match_id", "slot", "tick", F.col("x").alias("gx"), F.col("z").alias("gz"))
    d = d8_trajectories(spark, data_dir).join(given, ["match_id", "slot", "tick"]).select("match_id", distance(F.col("x"), F.col("z"), F.col("gx"), F.col("gz")).alias("d"))
    return d.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("d", F.lit(0.5)), 2).alias("median"), F.round(F.percentile("d", F.lit(0.99)), 2).alias("p99"))


def _along_sql(lane: str, axis: int) -> str:
    parts = []
    for seg in segments(lane):
        x0, z0, x1, z1, before, whole = seg
        length = ((x1 - x0) ** 2 + (z1 - z0) ** 2) ** 0.5
        value = f"{seg[axis]!r} + greatest(0.0, least(1.0, (s * {whole!r} - {before!r}) / {length!r})) * {seg[axis + 2] - seg[axis]!r}"
        parts.append(f"WHEN s * {whole!r} <= {before + length!r} THEN {value}")
    return f"CASE {' '.join(parts[:-1])} ELSE {parts[-1].split(' THEN ', 1)[1]} END"


def e12_wave_positions(spark: SparkSession, data_dir: str) -> DataFrame:
    """Where the waves of both sides are on each lane, at every tick of their life."""
    ticks = table(spark, data_dir, "matches", "match_id", "n_ticks").filter(F.col("n_ticks") > FIRST_WAVE)
    waves = ticks.withColumn("t0", F.explode(F.sequence(F.lit(FIRST_WAVE), F.col("n_ticks") - 1, F.lit(WAVE_EVERY))))
    at = waves.withColumn("tick", F.explode(F.sequence(F.col("t0"), F.least(F.col("t0") + WAVE_LIFE, F.col("n_ticks") - 1), F.lit(WAVE_STEP)))).withColumn("team", F.explode(F.array(F.lit(0), F.lit(1))))
    result = None
    for lane in LANES:
        whole = segments(lane)[0][5]
        gone = F.least(F.lit(1.0), WAVE_SPEED * (F.col("tick") - F.col("t0")) / whole)
        x, z = place_on(lane, F.col("s"))
        part = at.withColumn("s", F.when(F.col("team") == 0, gone).otherwise(1 - gone)).select("match_id", "t0", "tick", "team", F.lit(lane).alias("lane"), F.round(x, 4).alias("x"), F.round(z, 4).alias("z"))
        result = part if result is None else result.unionByName(part)
    return result


def _darkness(asked: np.ndarray, size: np.ndarray, bins: np.ndarray, p: np.ndarray, known: dict[str, np.ndarray]) -> list:
    true, x, z = (known[c].astype(float) for c in ("true_bin", "true_x", "true_z"))
    row = np.repeat(np.arange(len(size)), size)
    whole = lambda values: np.bincount(row, values, len(size))
    p_true = whole(np.where(bins == true[row], p, 0.0))
    i, j = np.divmod(bins, LATTICE)
    bx, bz = (i + 0.5) * BIN, (j + 0.5) * BIN
    apart = lambda ax, az, cx, cz: np.sqrt((ax - cx) * (ax - cx) + (az - cz) * (az - cz))
    nearest = np.minimum.reduceat(apart(bx, bz, x[row], z[row]), np.cumsum(size) - size)
    found = (p_true > 0).astype(np.int32), whole(p > p_true[row]) / size, nearest, apart(whole(bx * p), whole(bz * p), x, z)
    return [pa.array(v, mask=~(asked & ~np.isnan(true))) for v in found]


#: Of the heroes that are alive and hidden and whose place is known: whether the true bin has any mass, its rank, and distances.
_DARKNESS = Reading(pa.schema({"hit": pa.int32(), "rank": pa.float64(), "nearest": pa.float64(), "centre": pa.float64()}), _darkness)


def j10_belief_by_darkness(spark: SparkSession, data_dir: str) -> DataFrame:
    """How well the belief does by the time that a hero has been hidden: whether the true bin has any mass, its rank among
    the bins by density, the distance of the nearest bin with mass and of the centre of mass; bands of 20 ticks or more,
    and all together with a verdict."""
    order = Window.partitionBy("match_id", "slot").orderBy("tick")
    fog = base.visible_ticks(spark, data_dir).withColumn("seen_t", F.last(F.when(F.col("visible") == 1, F.col("tick")), True).over(order))
    dark = fog.filter("visible = 0").select("match_id", "slot", "tick", (F.col("tick") - F.col("seen_t")).alias("dark"))
    truth = true_bins(spark, data_dir).withColumnsRenamed({"x": "true_x", "z": "true_z"})
    rows = believed(spark, data_dir, [BeliefModel()], False, truth, _DARKNESS).filter("hit IS NOT NULL").join(dark, ["match_id", "slot", "tick"])
    band = F.when(F.col("dark").isNull(), "never seen").when(F.col("dark") < 5, "0-5").when(F.col("dark") < 15, "5-15").when(F.col("dark") < 45, "15-45").otherwise("45+")
    per = rows.select(F.explode(F.array(band, F.lit("all"))).alias("band"), "hit", "rank", F.round("nearest", 0).alias("nearest"), F.round("centre", 0).alias("centre"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    found = per.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 4).alias("support_hit"), F.round(F.avg("rank"), 4).alias("mean_rank"), half("nearest").alias("median_nearest"), half("centre").alias("median_centre")).filter("n >= 20")
    verdict = F.when(F.col("band") != "all", None).when((F.col("support_hit") > 0.4) & (F.col("median_centre") > 4 * F.greatest("median_nearest", F.lit(1.0))), "drift").when(F.col("support_hit") < 0.2, "collapse").otherwise("mixed")
    return found.withColumn("verdict", verdict)


QUERIES = {f.__name__: f for f in (d8_trajectories, d8_reckoning_error, e12_wave_positions, j10_belief_by_darkness)}
SQL = {
    "e12_wave_positions": f"""WITH w AS (SELECT match_id, n_ticks, unnest(range({FIRST_WAVE}, n_ticks, {WAVE_EVERY})) AS t0 FROM matches),
k AS (SELECT match_id, t0, unnest(range(t0, least(t0 + {WAVE_LIFE}, n_ticks - 1) + 1, {WAVE_STEP})) AS tick FROM w), teams AS (SELECT unnest([0, 1]) AS team),
"""
    + ", ".join(f"{lane} AS (SELECT match_id, t0, tick, team, '{lane}' AS lane, CASE WHEN team = 0 THEN g ELSE 1 - g END AS s FROM (SELECT *, least(1.0, {WAVE_SPEED} * (tick - t0) / {segments(lane)[0][5]!r}) AS g FROM k, teams))" for lane in LANES)
    + " UNION ALL ".join(f" SELECT match_id, CAST(t0 AS INT) AS t0, CAST(tick AS INT) AS tick, team, lane, round({_along_sql(lane, 0)}, 4) AS x, round({_along_sql(lane, 1)}, 4) AS z FROM {lane}" for lane in LANES),
}
