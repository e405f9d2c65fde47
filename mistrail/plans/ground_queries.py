"""Queries on a raster of ground: patches and walks (E), fields of view and what teams see with them (F, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistrail.functions.geometry import FOUNTAINS, world
from mistrail.functions.ground import Raster
from mistrail.operators.field_of_view import look_up, united, view_table
from mistrail.operators.terrain import brush_patches, collected, distances_from
from mistrail.plans import base
from mistrail.plans.vision import _WALKED, CELL, SIDE, all_sources, walked_cells

QUERIES, SQL = {}, {}
#: Greatest radius of a source in cells.
RADIUS = base.CHAMPION_SIGHT / CELL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ground(spark: SparkSession, data_dir: str) -> Raster:
    """The given tables hold no terrain: ground that any trajectory enters is open, the rest blocks sight. SIDE squared
    cells at most."""
    cells = walked_cells(spark, data_dir).select("i", "j", F.lit(True).alias("walkable"), F.lit(False).alias("blocks_sight"), F.lit(None).cast("int").alias("patch"))
    return collected(cells, SIDE)


_HOMES = [tuple(int(v / CELL) for v in world(FOUNTAINS[k])) for k in (0, 1)]
_CLOSED = f"{base.POSITIONS}, {_WALKED}, closed AS (SELECT a.i, b.j FROM range(0, {SIDE}) a(i), range(0, {SIDE}) b(j) ANTI JOIN walked w ON a.i = w.i AND b.j = w.j)"


@query(f"""WITH RECURSIVE {_CLOSED}, reach AS (SELECT i, j, i * 512 + j AS patch FROM closed
 UNION SELECT c.i, c.j, r.patch FROM reach r JOIN closed c ON abs(c.i - r.i) <= 1 AND abs(c.j - r.j) <= 1)
SELECT CAST(patch AS INT) AS patch, count(*) AS n_cells, CAST(min(i) AS INT) AS first_i, CAST(max(i) AS INT) AS last_i, CAST(min(j) AS INT) AS first_j, CAST(max(j) AS INT) AS last_j
FROM (SELECT i, j, min(patch) AS patch FROM reach GROUP BY i, j) GROUP BY patch""")
def e14_closed_patches(spark, data_dir):
    """Connected patches of ground that no trajectory enters."""
    every = spark.range(SIDE * SIDE).select(F.expr(f"CAST(id DIV {SIDE} AS INT)").alias("i"), F.expr(f"CAST(id % {SIDE} AS INT)").alias("j"))
    closed = every.join(walked_cells(spark, data_dir), ["i", "j"], "left_anti").withColumn("on", F.lit(True)).withColumn("raster", F.lit(0))
    return brush_patches(closed, ["raster"], "on").groupBy("patch").agg(F.count(F.lit(1)).alias("n_cells"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.min("j").alias("first_j"), F.max("j").alias("last_j"))


@query(f"""WITH RECURSIVE {base.POSITIONS}, {_WALKED}, steps AS (SELECT a.i, a.j, b.i AS ni, b.j AS nj, CASE WHEN a.i <> b.i AND a.j <> b.j THEN 99 ELSE 70 END AS d FROM walked a JOIN walked b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j)
 SEMI JOIN walked p ON p.i = b.i AND p.j = a.j SEMI JOIN walked q ON q.i = a.i AND q.j = b.j),
seeds AS (SELECT s.seed, w.i, w.j FROM (VALUES (0, {_HOMES[0][0]}, {_HOMES[0][1]}), (1, {_HOMES[1][0]}, {_HOMES[1][1]})) s(seed, si, sj) JOIN walked w ON true QUALIFY row_number() OVER (PARTITION BY s.seed ORDER BY (w.i - si) * (w.i - si) + (w.j - sj) * (w.j - sj), w.i, w.j) = 1),
walk(seed, i, j, d) USING KEY (seed, i, j) AS (SELECT seed, i, j, 0 AS d FROM seeds
 UNION (SELECT w.seed, s.ni, s.nj, min(w.d + s.d) FROM walk w JOIN steps s ON w.i = s.i AND w.j = s.j LEFT JOIN recurring.walk k ON k.seed = w.seed AND k.i = s.ni AND k.j = s.nj WHERE k.d IS NULL OR w.d + s.d < k.d GROUP BY w.seed, s.ni, s.nj))
SELECT seed, i, j, round(d / 70.0, 6) AS distance FROM walk""")
def e6_walk_distances(spark, data_dir):
    """Length of the shortest walk over open cells from each team's fountain (the open cell nearest to it), in cells."""
    homes = F.explode(F.array(*[F.struct(F.lit(k).alias("seed"), F.lit(i).alias("si"), F.lit(j).alias("sj")) for k, (i, j) in enumerate(_HOMES)]))
    d2 = (F.col("i") - F.col("h.si")) * (F.col("i") - F.col("h.si")) + (F.col("j") - F.col("h.sj")) * (F.col("j") - F.col("h.sj"))
    seeds = walked_cells(spark, data_dir).withColumn("h", homes).groupBy("h.seed").agg(F.min(F.struct(d2.alias("d2"), "i", "j")).alias("b")).select("seed", "b.i", "b.j")
    return distances_from(seeds, ground(spark, data_dir)).withColumn("distance", F.round("distance", 6))


def sight_table(spark: SparkSession, data_dir: str) -> DataFrame:
    """(i, j, words): the field of view of every open cell."""
    return view_table(ground(spark, data_dir), walked_cells(spark, data_dir), RADIUS)


@query()
def f1_fields_of_view(spark, data_dir):
    """Cells seen from each open cell, swept by octants, as bits of a window, and how many they are."""
    return sight_table(spark, data_dir).withColumn("n_seen", F.aggregate("words", F.lit(0), lambda n, w: n + F.bit_count(w)))


def placed_sources(spark: SparkSession, data_dir: str) -> DataFrame:
    """All sources by cell, with their radius in cells; ``patch`` is null: no brush is known."""
    cell = lambda c: F.least(F.floor(F.col(c) / CELL), F.lit(SIDE - 1)).cast("int")
    return all_sources(spark, data_dir).select("match_id", "tick", "team", "class", cell("x").alias("i"), cell("z").alias("j"), (F.col("r") / CELL).alias("r"), F.lit(None).cast("int").alias("patch"))


def seen_ground(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, tick, team, i, bits): what a team's sources see with the ground in the way; a row of the grid is a word."""
    found = look_up(placed_sources(spark, data_dir), sight_table(spark, data_dir), ground(spark, data_dir), RADIUS)
    return united(found, ["match_id", "tick", "team"], RADIUS).select("match_id", "tick", "team", "i", "bits")


@query()
def f7_occluded_masks(spark, data_dir):
    """What a team's sources see at every tick, cut by the ground: rows of the grid as words of 64 bits."""
    return seen_ground(spark, data_dir)


@query()
def f5_lookups(spark, data_dir):
    """Sources whose view was in the table and those whose view had to be computed, per match and class."""
    found = look_up(placed_sources(spark, data_dir), sight_table(spark, data_dir), ground(spark, data_dir), RADIUS)
    return found.groupBy("match_id", "class").agg(F.count_if(~F.col("live")).alias("n_in_table"), F.count_if("live").alias("n_live"))


@query()
def j5_occluded_agreement(spark, data_dir):
    """Agreement of sight that the ground cuts with the fog record, per match."""
    teams = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", (1 - F.col("team")).alias("team"))
    cell = lambda c: F.least(F.floor(F.col(c) / CELL), F.lit(SIDE - 1)).cast("int")
    targets = base.positions(spark, data_dir).join(teams, ["match_id", "slot"]).select("match_id", "tick", "slot", "team", cell("x").alias("i"), cell("z").alias("j"))
    ours = targets.join(seen_ground(spark, data_dir), ["match_id", "tick", "team", "i"], "left").withColumn("ours", F.coalesce(F.getbit("bits", F.col("j")).cast("int"), F.lit(0)))
    fog = base.visible_ticks(spark, data_dir).select("match_id", "slot", "tick", F.col("visible").alias("fog"))
    both = ours.join(fog, ["match_id", "slot", "tick"])
    return both.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n_ticks"), F.round(F.avg((F.col("ours") == F.col("fog")).cast("int")), 6).alias("agree"), F.count_if((F.col("ours") == 1) & (F.col("fog") == 0)).alias("n_false_seen"), F.count_if((F.col("ours") == 0) & (F.col("fog") == 1)).alias("n_missed")
    )
