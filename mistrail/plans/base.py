"""Cleaned tables that many queries begin with, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mistrail.sources.tables import table

MAP_SIDE = 14_760.0
#: Sight radii in world units: of champions, and of wards by kind where the row doesn't say.
CHAMPION_SIGHT = 1_350.0
TIME_EPSILON = 1e-6


def roster(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, net_id, team) of each hero, from its first keyframe; team null where none tells it."""
    hero = table(spark, data_dir, "hero", "match_id", "slot", "net_id", "team")
    return hero.groupBy("match_id", "slot").agg(F.min("net_id").alias("net_id"), F.max(F.when(F.col("team") >= 0, F.col("team"))).alias("team"))


def positions(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, tick, slot, x, z, speed) of valid trajectory rows on the map, one per slot and tick."""
    rows = table(spark, data_dir, "attribution").filter(f"valid AND x BETWEEN 0 AND {MAP_SIDE} AND z BETWEEN 0 AND {MAP_SIDE} AND NOT isnan(x) AND NOT isnan(z)")
    return rows.groupBy("match_id", "tick", "slot").agg(F.min("x").alias("x"), F.min("z").alias("z"), F.min("speed").alias("speed"))


def anchors(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, t, x, z, anchor_kind, target) of usable anchors, resent ones once."""
    rows = table(spark, data_dir, "anchor").filter(f"t > {TIME_EPSILON} AND NOT isnan(t) AND x BETWEEN 0 AND {MAP_SIDE} AND z BETWEEN 0 AND {MAP_SIDE} AND NOT isnan(x) AND NOT isnan(z) AND NOT (x = 0 AND z = 0)")
    return rows.groupBy("match_id", "slot", "t").agg(F.min("x").alias("x"), F.min("z").alias("z"), F.max("anchor_kind").alias("anchor_kind"), F.max("target").alias("target"))


def wards(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, net_id, owner_slot, team, kind, x, z, t0, t1, sight), one row per ward.

    An end that is missing is modelled by kind: a totem lasts 105 s, control and farsight wards stay, others last 120 s.
    """
    kind = F.lower(F.trim("kind"))
    t1 = F.when(F.col("t1").isNotNull() & ~F.isnan("t1") & (F.col("t1") > F.col("t0")), F.col("t1"))
    rows = table(spark, data_dir, "ward_event").select("match_id", "net_id", "owner_slot", "team", F.when(kind != "", kind).alias("kind"), "x", "z", "t0", t1.alias("t1"), "sight")
    one = rows.groupBy("match_id", "net_id").agg(*[F.max(c).alias(c) for c in ("owner_slot", "team", "kind", "x", "z", "t0", "t1", "sight")])
    modelled = F.when(F.col("kind") == "totem", F.col("t0") + 105.0).when(F.col("kind").isin("control", "farsight"), float("inf")).otherwise(F.col("t0") + 120.0)
    return one.withColumn("t1", F.coalesce("t1", modelled)).withColumn("sight", F.coalesce("sight", F.lit(900.0)))


def fog_packets(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, team, t, seq, visible) of the heroes' fog packets, resent ones once. Leaving the fog is to be seen."""
    fog = table(spark, data_dir, "fog").filter("leaving IS NOT NULL").distinct()
    return fog.join(roster(spark, data_dir), ["match_id", "net_id"]).select("match_id", "slot", "team", "t", "seq", F.col("leaving").cast("int").alias("visible"))


def fog_transitions(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, team, t, seq, visible): one row per change of what the other side sees of a hero.

    Of equal packets at one time the first counts; packets that change nothing are dropped; heroes begin hidden.
    """
    first = Window.partitionBy("match_id", "slot", "t", "visible").orderBy("seq")
    order = Window.partitionBy("match_id", "slot").orderBy("t", "seq")
    packets = fog_packets(spark, data_dir).withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    return packets.withColumn("before", F.coalesce(F.lag("visible").over(order), F.lit(0))).filter("visible <> before").drop("before")


def visible_ticks(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, team, tick, visible) for each tick of each hero: the state of its last transition up to the tick.

    Each transition is spread over the ticks up to the next one: an interval join without a join.
    """
    order = Window.partitionBy("match_id", "slot").orderBy("t", "seq")
    ticks = table(spark, data_dir, "matches", "match_id", "n_ticks")
    start = roster(spark, data_dir).select("match_id", "slot", "team", F.lit(-1.0).alias("t"), F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("visible"))
    changes = start.unionByName(fog_transitions(spark, data_dir)).join(ticks, "match_id")
    begin = F.greatest(F.ceil(F.col("t") - 1e-9), F.lit(0))
    spread = changes.withColumn("first", begin).withColumn("next", F.coalesce(F.lead(begin).over(order), F.col("n_ticks").cast("long")))
    spread = spread.withColumn("last", F.least("next", F.col("n_ticks").cast("long")) - 1).filter("last >= first")
    return spread.select("match_id", "slot", "team", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("tick"), "visible")


ROSTER = "roster AS (SELECT match_id, slot, min(net_id) AS net_id, max(CASE WHEN team >= 0 THEN team END) AS team FROM hero GROUP BY match_id, slot)"
_ON_MAP = "isfinite(x) AND isfinite(z) AND x BETWEEN 0 AND 14760 AND z BETWEEN 0 AND 14760"
POSITIONS = f"positions AS (SELECT match_id, tick, slot, min(x) AS x, min(z) AS z, min(speed) AS speed FROM attribution WHERE valid AND {_ON_MAP} GROUP BY match_id, tick, slot)"
ANCHORS = f"anchors AS (SELECT match_id, slot, t, min(x) AS x, min(z) AS z, max(anchor_kind) AS anchor_kind, max(target) AS target FROM anchor WHERE t > 0.000001 AND NOT isnan(t) AND {_ON_MAP} AND NOT (x = 0 AND z = 0) GROUP BY match_id, slot, t)"
WARDS = """wards AS (
  SELECT match_id, net_id, owner_slot, team, kind, x, z, t0, coalesce(t1, CASE WHEN kind = 'totem' THEN t0 + 105.0 WHEN kind IN ('control', 'farsight') THEN CAST('Infinity' AS DOUBLE) ELSE t0 + 120.0 END) AS t1, coalesce(sight, 900.0) AS sight
  FROM (SELECT match_id, net_id, max(owner_slot) AS owner_slot, max(team) AS team, max(nullif(lower(trim(kind)), '')) AS kind, max(x) AS x, max(z) AS z, max(t0) AS t0,
    max(CASE WHEN NOT isnan(t1) AND t1 > t0 THEN t1 END) AS t1, max(sight) AS sight FROM ward_event GROUP BY match_id, net_id))"""
FOG = """packets AS (
  SELECT DISTINCT f.match_id, r.slot, r.team, f.t, f.seq, CAST(f.leaving AS INT) AS visible FROM fog f JOIN roster r ON f.match_id = r.match_id AND f.net_id = r.net_id WHERE f.leaving IS NOT NULL)"""
TRANSITIONS = """firsts AS (SELECT * FROM packets QUALIFY row_number() OVER (PARTITION BY match_id, slot, t, visible ORDER BY seq) = 1),
transitions AS (SELECT * FROM firsts QUALIFY visible <> coalesce(lag(visible) OVER (PARTITION BY match_id, slot ORDER BY t, seq), 0))"""
TICKS = """ticks AS (SELECT r.match_id, r.slot, r.team, unnest(range(0, m.n_ticks)) AS tick FROM roster r JOIN matches m ON r.match_id = m.match_id),
visible_ticks AS (
  SELECT k.match_id, k.slot, k.team, CAST(k.tick AS INT) AS tick, coalesce(c.visible, 0) AS visible
  FROM (SELECT *, tick + 1e-9 AS upto FROM ticks) k ASOF LEFT JOIN (SELECT * FROM transitions QUALIFY row_number() OVER (PARTITION BY match_id, slot, t ORDER BY seq DESC) = 1) c
  ON k.match_id = c.match_id AND k.slot = c.slot AND k.upto >= c.t)"""
