"""Queries on what each side could see (F, G) and how that agrees with the fog record (J)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mistrail.functions.arrow_groups import floats, whole_groups
from mistrail.functions.geometry import FOUNTAINS, LANES, distance, lane_distance, lane_distance_sql, lane_fraction, segments, world
from mistrail.operators.time_joins import as_of
from mistrail.plans import base
from mistrail.plans.packet_log import _WAYPOINTS, waypoints
from mistrail.sources.tables import table

QUERIES, SQL = {}, {}
#: Grid of the line-of-sight and mask queries, and its cell.
SIDE = 64
CELL = base.MAP_SIDE / SIDE
#: Radius and seconds of the disc around an attacker that the fog gives away.
REVEAL_RADIUS, REVEAL_S = 400.0, 4.5
#: Front line: seconds of the kernel's e-folding and of its window, weight and place of the prior, bounds, and how near to
#: a lane an attack counts for it.
TAU, WINDOW_S, PRIOR_W, PRIOR_S, LOW_S, HIGH_S, CONTACT_R = 20.0, 100, 8.0, 0.5, 0.15, 0.85, 1400.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.startswith(("WITH", "SELECT")) else "WITH " + sql
        return f

    return add


def champion_sources(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, tick, team, x, z, r, class) of heroes with a position and a team."""
    teams = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", "team")
    return base.positions(spark, data_dir).join(teams, ["match_id", "slot"]).select("match_id", "tick", "team", "x", "z", F.lit(base.CHAMPION_SIGHT).alias("r"), F.lit("champion").alias("class"))


def ward_spans(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same of wards, one row for the ticks ``first`` to ``last`` of their closed lifetime within the match."""
    wards = base.wards(spark, data_dir).filter("team >= 0").join(table(spark, data_dir, "matches", "match_id", "n_ticks"), "match_id")
    last = F.least(F.floor(F.least(F.col("t1"), F.lit(1e9))), F.col("n_ticks") - 1).cast("int")
    spread = wards.withColumn("first", F.ceil("t0").cast("int")).withColumn("last", last).filter("last >= first")
    return spread.select("match_id", "first", "last", "team", "x", "z", F.col("sight").alias("r"), F.lit("ward").alias("class"))


def per_tick(spans: DataFrame) -> DataFrame:
    """``spans`` with a row for each of their ticks."""
    return spans.select("match_id", F.explode(F.sequence("first", "last")).alias("tick"), *[c for c in spans.columns if c not in ("match_id", "first", "last")])


def ward_sources(spark: SparkSession, data_dir: str) -> DataFrame:
    return per_tick(ward_spans(spark, data_dir))


_SOURCES = f"""{base.ROSTER}, {base.POSITIONS}, {base.WARDS},
champion_sources AS (SELECT p.match_id, p.tick, r.team, p.x, p.z, 1350.0 AS r, 'champion' AS class FROM positions p JOIN roster r ON p.match_id = r.match_id AND p.slot = r.slot WHERE r.team IS NOT NULL),
ward_spans AS (SELECT w.*, CAST(ceil(t0) AS INT) AS a, CAST(least(floor(least(t1, 1e9)), m.n_ticks - 1) AS INT) AS b FROM wards w JOIN matches m ON w.match_id = m.match_id WHERE team >= 0),
ward_sources AS (SELECT match_id, unnest(range(a, b + 1)) AS tick, team, x, z, sight AS r, 'ward' AS class FROM ward_spans WHERE b >= a),
sources AS (SELECT match_id, CAST(tick AS INT) AS tick, team, x, z, r, class FROM champion_sources UNION ALL SELECT match_id, CAST(tick AS INT), team, x, z, r, class FROM ward_sources)"""


def sources(spark: SparkSession, data_dir: str) -> DataFrame:
    return champion_sources(spark, data_dir).unionByName(ward_sources(spark, data_dir))


def probes(spark: SparkSession, data_dir: str, lit: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(match_id, tick, slot, team, tx, tz, d, r, class, covers) of each hero against each source of the other team; with
    ``asked`` (match_id, slot, tick), of these heroes at these ticks only."""
    teams = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", F.col("team").alias("own"))
    targets = base.positions(spark, data_dir).join(teams, ["match_id", "slot"]).select("match_id", "tick", "slot", "own", F.col("x").alias("tx"), F.col("z").alias("tz"), (1 - F.col("own")).alias("team"))
    if asked is not None:
        targets = targets.join(asked, ["match_id", "slot", "tick"], "left_semi")
    joined = targets.join(sources(spark, data_dir) if lit is None else lit, ["match_id", "tick", "team"], "left")
    d2 = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("z") - F.col("tz")) * (F.col("z") - F.col("tz"))
    return joined.select("match_id", "tick", "slot", "team", "tx", "tz", F.sqrt(d2).alias("d"), "r", "class", F.coalesce(d2 <= F.col("r") * F.col("r"), F.lit(False)).alias("covers"))


def _probes_sql(lit: str, probes: str) -> str:
    return f"""{probes} AS (SELECT t.match_id, t.tick, t.slot, t.team, t.tx, t.tz, sqrt((s.x - t.tx) * (s.x - t.tx) + (s.z - t.tz) * (s.z - t.tz)) AS d, s.class,
 coalesce((s.x - t.tx) * (s.x - t.tx) + (s.z - t.tz) * (s.z - t.tz) <= s.r * s.r, false) AS covers FROM targets t LEFT JOIN {lit} s ON t.match_id = s.match_id AND t.tick = s.tick AND t.team = s.team)"""


_PROBES = _SOURCES + """, targets AS (SELECT p.match_id, p.tick, p.slot, p.x AS tx, p.z AS tz, 1 - r.team AS team FROM positions p JOIN roster r ON p.match_id = r.match_id AND p.slot = r.slot WHERE r.team IS NOT NULL),
""" + _probes_sql("sources", "probes") + """,
seen AS (SELECT match_id, tick, slot, team, CAST(bool_or(covers) AS INT) AS visible, min(d) AS nearest FROM probes GROUP BY match_id, tick, slot, team)"""


def seen(spark: SparkSession, data_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """(match_id, tick, slot, team, visible, nearest): whether ``team`` sees the hero by its sources, and the nearest one's distance."""
    return probes(spark, data_dir, asked=asked).groupBy("match_id", "tick", "slot", "team").agg(F.max(F.col("covers").cast("int")).alias("visible"), F.min("d").alias("nearest"))


_WALKED = f"walked AS (SELECT DISTINCT CAST(floor(x / {CELL}) AS INT) AS i, CAST(floor(z / {CELL}) AS INT) AS j FROM positions)"


def walked_cells(spark: SparkSession, data_dir: str) -> DataFrame:
    """(i, j) of the coarse cells that any trajectory enters: at most SIDE squared rows, for ground that doesn't block sight."""
    return base.positions(spark, data_dir).select(F.floor(F.col("x") / CELL).cast("int").alias("i"), F.floor(F.col("z") / CELL).cast("int").alias("j")).distinct()


def crossed(ax, az, bx, bz):
    """The cells that the segment from (ax, az) to (bx, bz) crosses, in units of a cell, as an array of (i, j).

    The segment is cut where it meets the lines of the grid; the middle of each part names its cell.
    """
    lines = lambda a, b: F.when(F.floor(a) != F.floor(b), F.transform(F.sequence(F.floor(F.least(a, b)) + 1, F.floor(F.greatest(a, b))), lambda k: (k - a) / (b - a))).otherwise(F.array().cast("array<double>"))
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), lines(ax, bx), lines(az, bz)))
    parts = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda f, g: F.struct(f.alias("f"), g.alias("g")))
    middles = F.transform(F.filter(parts, lambda p: p["g"] - p["f"] > 1e-9), lambda p: (p["f"] + p["g"]) / 2)
    return F.array_distinct(F.transform(middles, lambda m: F.struct(F.floor(ax + (bx - ax) * m).cast("int").alias("i"), F.floor(az + (bz - az) * m).cast("int").alias("j"))))


def _crossed_sql(ax: str, az: str, bx: str, bz: str, rows: str) -> str:
    """``rows`` with ``c``, one row per crossed cell."""
    lines = lambda a, b: f"CASE WHEN floor({a}) <> floor({b}) THEN list_transform(range(CAST(floor(least({a}, {b})) AS BIGINT) + 1, CAST(floor(greatest({a}, {b})) AS BIGINT) + 1), lambda k: (k - {a}) / ({b} - {a})) ELSE CAST([] AS DOUBLE[]) END"
    return f"""(SELECT *, unnest(list_distinct(list_transform(list_filter(list_transform(range(1, len(cuts)), lambda k: [cuts[k], cuts[k + 1]]), lambda p: p[2] - p[1] > 1e-9),
 lambda p: struct_pack(i := CAST(floor({ax} + ({bx} - {ax}) * ((p[1] + p[2]) / 2)) AS INT), j := CAST(floor({az} + ({bz} - {az}) * ((p[1] + p[2]) / 2)) AS INT))))) AS c
 FROM (SELECT *, list_sort(list_concat(list_concat([0.0::DOUBLE, 1.0::DOUBLE], {lines(ax, bx)}), {lines(az, bz)})) AS cuts FROM {rows}))"""


@query(f"""WITH {base.ROSTER}, {base.POSITIONS}, {_WALKED}, t AS (SELECT p.match_id, p.tick, p.slot, r.team, p.x, p.z FROM positions p JOIN roster r ON p.match_id = r.match_id AND p.slot = r.slot WHERE r.team IS NOT NULL),
pairs AS (SELECT a.match_id, a.tick, a.slot AS observer, b.slot AS target, a.x / {CELL} AS ax, a.z / {CELL} AS az, b.x / {CELL} AS bx, b.z / {CELL} AS bz FROM t a JOIN t b ON a.match_id = b.match_id AND a.tick = b.tick AND a.team < b.team
 WHERE (a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z) <= 1350.0 * 1350.0),
cells AS {_crossed_sql('ax', 'az', 'bx', 'bz', 'pairs')}
SELECT c.match_id, c.tick, c.observer, c.target, count(*) AS n_cells, count(*) FILTER (WHERE w.i IS NULL) AS n_blocked, count(*) FILTER (WHERE w.i IS NULL) = 0 AS clear FROM cells c LEFT JOIN walked w ON c.c.i = w.i AND c.c.j = w.j GROUP BY c.match_id, c.tick, c.observer, c.target""")
def f2_sight_lines(spark, data_dir):
    """Opponents within sight of each other, the cells that the line between them crosses, and those of them that are no
    walked ground.

    Every crossed cell is looked up, by an equality join.
    """
    teams = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", "team")
    t = base.positions(spark, data_dir).join(teams, ["match_id", "slot"])
    a = t.filter("team = 0").select("match_id", "tick", F.col("slot").alias("observer"), F.col("x").alias("ax"), F.col("z").alias("az"))
    b = t.filter("team = 1").select("match_id", "tick", F.col("slot").alias("target"), F.col("x").alias("bx"), F.col("z").alias("bz"))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("az") - F.col("bz")) * (F.col("az") - F.col("bz"))
    pairs = a.join(b, ["match_id", "tick"]).filter(d2 <= base.CHAMPION_SIGHT**2).select("match_id", "tick", "observer", "target", *[(F.col(c) / CELL).alias(c) for c in ("ax", "az", "bx", "bz")])
    cells = pairs.select("match_id", "tick", "observer", "target", F.inline(crossed(*[F.col(c) for c in ("ax", "az", "bx", "bz")])))
    blocked = F.count_if(F.col("open").isNull())
    return cells.join(walked_cells(spark, data_dir).withColumn("open", F.lit(1)), ["i", "j"], "left").groupBy("match_id", "tick", "observer", "target").agg(F.count(F.lit(1)).alias("n_cells"), blocked.alias("n_blocked"), (blocked == 0).alias("clear"))


@query(f"""WITH {base.POSITIONS}, {_WALKED}, o AS (SELECT a.dx, b.dz, 0.5::DOUBLE AS ax, 0.5::DOUBLE AS az, a.dx + 0.5::DOUBLE AS bx, b.dz + 0.5::DOUBLE AS bz FROM range(-5, 6) a(dx), range(-5, 6) b(dz) WHERE (dx * dx + dz * dz) * {CELL * CELL!r} <= 1350.0 * 1350.0),
steps AS (SELECT w.i, w.j, o.dx, o.dz, w.i + o.c.i AS si, w.j + o.c.j AS sj FROM walked w, {_crossed_sql('ax', 'az', 'bx', 'bz', 'o')} o),
open AS (SELECT s.i, s.j, dx, dz FROM steps s LEFT JOIN walked w ON s.si = w.i AND s.sj = w.j GROUP BY s.i, s.j, dx, dz HAVING count(*) FILTER (WHERE w.i IS NULL) = 0)
SELECT i, j, count(*) AS n_visible, CAST(bit_or(CASE WHEN (dx + 5) * 11 + dz + 5 < 62 THEN CAST(1 AS BIGINT) << CAST((dx + 5) * 11 + dz + 5 AS INT) ELSE 0 END) AS BIGINT) AS low_word,
 CAST(bit_or(CASE WHEN (dx + 5) * 11 + dz + 5 >= 62 THEN CAST(1 AS BIGINT) << CAST((dx + 5) * 11 + dz + 5 - 62 AS INT) ELSE 0 END) AS BIGINT) AS high_word FROM open GROUP BY i, j""")
def f4_sight_table(spark, data_dir):
    """The cells visible from each walked cell within a hero's sight, as two words of bits (11 x 11 window)."""
    walked = walked_cells(spark, data_dir)
    offsets = [(dx, dz) for dx in range(-5, 6) for dz in range(-5, 6) if (dx * dx + dz * dz) * CELL * CELL <= base.CHAMPION_SIGHT**2]
    half = F.lit(0.5)
    rays = walked.withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dz")) for a, b in offsets])))
    steps = rays.select("i", "j", "o.dx", "o.dz", F.inline(crossed(half, half, F.col("o.dx") + half, F.col("o.dz") + half)).alias("ci", "cj")).select("i", "j", "dx", "dz", (F.col("i") + F.col("ci")).alias("si"), (F.col("j") + F.col("cj")).alias("sj"))
    ground = walked.select(F.col("i").alias("si"), F.col("j").alias("sj"), F.lit(1).alias("open"))
    lines = steps.join(ground, ["si", "sj"], "left").groupBy("i", "j", "dx", "dz").agg(F.count_if(F.col("open").isNull()).alias("blocked")).filter("blocked = 0")
    bit = (F.col("dx") + 5) * 11 + F.col("dz") + 5
    lines = lines.withColumn("bit", bit.cast("int"))
    word = lambda cond, shift: F.bit_or(F.when(cond, F.expr(f"shiftleft(1L, {shift})")).otherwise(F.lit(0).cast("long")))
    return lines.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_visible"), word(F.col("bit") < 62, "bit").alias("low_word"), word(F.col("bit") >= 62, "bit - 62").alias("high_word"))


@query(f"""WITH {base.POSITIONS}, {_WALKED}, near AS (SELECT i, j, i + di AS ni, j + dj AS nj FROM walked, range(-1, 2) a(di), range(-1, 2) b(dj) WHERE di <> 0 OR dj <> 0)
SELECT n.i, n.j, count(*) FILTER (WHERE w.i IS NULL) AS n_closed FROM near n LEFT JOIN walked w ON n.ni = w.i AND n.nj = w.j WHERE n.ni BETWEEN 0 AND {SIDE - 1} AND n.nj BETWEEN 0 AND {SIDE - 1} GROUP BY n.i, n.j HAVING count(*) FILTER (WHERE w.i IS NULL) > 0""")
def f3_boundary_cells(spark, data_dir):
    """Walked cells next to closed ground, where sight lines are in doubt."""
    walked = walked_cells(spark, data_dir)
    around = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    near = walked.withColumn("o", F.explode(around)).select("i", "j", (F.col("i") + F.col("o.di")).alias("ni"), (F.col("j") + F.col("o.dj")).alias("nj")).filter(F.col("ni").between(0, SIDE - 1) & F.col("nj").between(0, SIDE - 1))
    ground = walked.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.lit(1).alias("open"))
    return near.join(ground, ["ni", "nj"], "left").groupBy("i", "j").agg(F.count_if(F.col("open").isNull()).alias("n_closed")).filter("n_closed > 0")


@query(_WAYPOINTS + f""", {base.POSITIONS}, {_WALKED}, p AS (SELECT match_id, line_id, event_no, point_no, x, z FROM waypoints WHERE x IS NOT NULL AND z IS NOT NULL),
t AS (SELECT p.*, w.i, w.j, ((w.i + 0.5) * {CELL} - x) * ((w.i + 0.5) * {CELL} - x) + ((w.j + 0.5) * {CELL} - z) * ((w.j + 0.5) * {CELL} - z) AS d2 FROM p, walked w)
SELECT match_id, line_id, event_no, point_no, i, j, round(sqrt(d2), 4) AS distance FROM t QUALIFY row_number() OVER (PARTITION BY match_id, line_id, event_no, point_no, x, z ORDER BY d2, i, j) = 1""")
def e10_nearest_open_cells(spark, data_dir):
    """The nearest walked cell of each waypoint: the cells around it are looked up by equality, first those within three
    cells and then, for a point that has none nearer than those beyond may be, all of the grid."""
    at = lambda c: F.floor(F.col(c) / CELL).cast("int")
    walked = walked_cells(spark, data_dir)
    key = ["match_id", "line_id", "event_no", "point_no", "x", "z"]
    points = waypoints(spark, data_dir).filter("x IS NOT NULL AND z IS NOT NULL").select(*key)
    d2 = ((F.col("i") + 0.5) * CELL - F.col("x")) * ((F.col("i") + 0.5) * CELL - F.col("x")) + ((F.col("j") + 0.5) * CELL - F.col("z")) * ((F.col("j") + 0.5) * CELL - F.col("z"))
    best = lambda tries: tries.join(walked, ["i", "j"]).groupBy(*key).agg(F.min(F.struct(d2.alias("d2"), "i", "j")).alias("b"))
    window = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-3, 4) for b in range(-3, 4)])
    near = best(points.withColumn("o", F.explode(window)).select(*key, (at("x") + F.col("o.di")).alias("i"), (at("z") + F.col("o.dj")).alias("j")))
    sure = near.filter(F.col("b.d2") <= (3.5 * CELL) ** 2)
    rest = points.join(sure.select(*key), key, "left_anti")
    far = best(rest.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SIDE)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(SIDE)))))
    found = sure.unionByName(far)
    return found.select("match_id", "line_id", "event_no", "point_no", "b.i", "b.j", F.round(F.sqrt("b.d2"), 4).alias("distance"))


def _masks_sql(lit: str) -> str:
    return f"""few AS (SELECT *, CAST(floor(x / {CELL}) AS INT) AS ci, CAST(floor(z / {CELL}) AS INT) AS cj FROM {lit}),
spread AS (SELECT match_id, tick, team, x, z, r, ci + di AS i, cj + dj AS j FROM few, range(-6, 7) a(di), range(-6, 7) b(dj)),
lit AS (SELECT DISTINCT match_id, tick, team, i, j FROM spread WHERE i BETWEEN 0 AND {SIDE - 1} AND j BETWEEN 0 AND {SIDE - 1} AND pow((i + 0.5) * {CELL} - x, 2) + pow((j + 0.5) * {CELL} - z, 2) <= r * r),
masks AS (SELECT match_id, tick, team, CAST(i AS INT) AS word, bit_or(CAST(1 AS BIGINT) << CAST(j % 32 AS INT)) FILTER (WHERE j < 32) AS low, bit_or(CAST(1 AS BIGINT) << CAST(j % 32 AS INT)) FILTER (WHERE j >= 32) AS high FROM lit GROUP BY match_id, tick, team, i)"""


#: Masks of the base sources, and of these with the reveals (see ``_REVEALS``).
_MASKS = _SOURCES + ", " + _masks_sql("sources")


def _row_bits(first, last):
    """Bits first..last of a word of 32; 0 where there are none."""
    first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(31))
    return F.when(first <= last, F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), last - first + 1) - 1, first)).otherwise(F.lit(0).cast("long"))


def team_masks(lit: DataFrame) -> DataFrame:
    """(match_id, tick, team, word, low, high): the cells that a team's sources light up, a row of the grid in two words.

    Sources of a team and tick are brought together once; each is spread over the rows of the grid around it, where it
    lights one run of cells, and the union of sources is a bitwise or of these runs, without another shuffle.
    """
    few = lit.select("match_id", "tick", "team", "x", "z", "r").repartition("match_id", "tick", "team")
    around = F.array(*[F.lit(a) for a in range(-6, 7)])
    rows = few.withColumn("d", F.explode(around)).withColumn("i", (F.floor(F.col("x") / CELL) + F.col("d")).cast("int")).withColumn("cj", F.floor(F.col("z") / CELL).cast("int")).filter(F.col("i").between(0, SIDE - 1))
    dx, centre = (F.col("i") + 0.5) * CELL - F.col("x"), lambda j: (j + 0.5) * CELL - F.col("z")
    inside = lambda j: dx * dx + centre(j) * centre(j) <= F.col("r") * F.col("r")
    half = F.sqrt(F.greatest(F.col("r") * F.col("r") - dx * dx, F.lit(0.0)))
    # The root may be off by a last digit: the run is taken a trifle too long, and its ends are tried by the distance itself.
    rows = rows.withColumn("a", F.ceil((F.col("z") - half) / CELL - 0.5 - 1e-9).cast("int")).withColumn("b", F.floor((F.col("z") + half) / CELL - 0.5 + 1e-9).cast("int"))
    first, last = F.col("a") + F.when(inside(F.col("a")), 0).otherwise(1), F.col("b") - F.when(inside(F.col("b")), 0).otherwise(1)
    rows = rows.withColumn("first", F.greatest(first, F.col("cj") - 6, F.lit(0))).withColumn("last", F.least(last, F.col("cj") + 6, F.lit(SIDE - 1)))
    bits = rows.select("match_id", "tick", "team", F.col("i").alias("word"), _row_bits(F.col("first"), F.col("last")).alias("low"), _row_bits(F.col("first") - 32, F.col("last") - 32).alias("high"))
    # Empty rows go at the end: a filter on first <= last would be pushed down with its expressions repeated, too long to compile.
    return bits.groupBy("match_id", "tick", "team", "word").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high")).filter("low <> 0 OR high <> 0")


def mask_areas(masks: DataFrame) -> DataFrame:
    return masks.groupBy("match_id", "tick", "team").agg(F.sum(F.bit_count("low") + F.bit_count("high")).alias("n_cells"))


def coarse_masks(masks: DataFrame) -> DataFrame:
    quarters = masks.withColumn("j", F.explode(F.array(*[F.lit(q) for q in range(8)])))
    lit = F.expr("CASE WHEN j < 4 THEN (shiftrightunsigned(low, 8 * j) & 255L) ELSE (shiftrightunsigned(high, 8 * (j - 4)) & 255L) END") != 0
    coarse = quarters.groupBy("match_id", "tick", "team", F.expr("CAST(word DIV 8 AS INT)").alias("i"), "j").agg(F.max(lit).alias("lit"))
    bit = F.when(F.col("lit"), F.expr("shiftleft(1L, i * 8 + j)")).otherwise(F.lit(0).cast("long"))
    return coarse.groupBy("match_id", "tick", "team").agg(F.bit_or(bit).alias("cells"), F.count_if("lit").alias("n_lit"))


_WORDS = " SELECT match_id, tick, team, word, coalesce(low, 0) AS low, coalesce(high, 0) AS high FROM masks"
_AREAS = " SELECT match_id, tick, team, CAST(sum(bit_count(coalesce(low, 0)) + bit_count(coalesce(high, 0))) AS BIGINT) AS n_cells FROM masks GROUP BY match_id, tick, team"
_COARSE = """, c AS (SELECT match_id, tick, team, word, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS q, coalesce(low, 0) AS low, coalesce(high, 0) AS high FROM masks),
d AS (SELECT match_id, tick, team, word // 8 AS i, q AS j, bool_or(CASE WHEN q < 4 THEN ((low >> (8 * q)) & 255) ELSE ((high >> (8 * (q - 4))) & 255) END <> 0) AS lit FROM c GROUP BY ALL)
SELECT match_id, tick, team, CAST(bit_or(CASE WHEN NOT lit THEN 0 WHEN i * 8 + j = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(i * 8 + j AS INT) END) AS BIGINT) AS cells, count(*) FILTER (WHERE lit) AS n_lit FROM d GROUP BY match_id, tick, team"""


@query(_MASKS + _WORDS)
def f7_team_masks_per_tick(spark, data_dir):
    """Union of a team's base sources (heroes and wards) on the grid, at every tick."""
    return team_masks(sources(spark, data_dir))


@query(_MASKS + _AREAS)
def f9_mask_areas_per_tick(spark, data_dir):
    """Cells lit by a team's base sources at every tick, by counting bits."""
    return mask_areas(team_masks(sources(spark, data_dir)))


@query(_MASKS + _COARSE)
def k5_coarse_masks_per_tick(spark, data_dir):
    """Masks of the base sources at an eighth of the resolution, at every tick: a coarse cell is lit if any of its cells is."""
    return coarse_masks(team_masks(sources(spark, data_dir)))


@query(_SOURCES + " SELECT match_id, CAST(tick AS INT) AS tick, team, count(*) AS n_wards, max(r) AS widest FROM ward_sources GROUP BY match_id, tick, team")
def g4_ward_layer(spark, data_dir):
    """Living wards of each team at each tick."""
    return ward_sources(spark, data_dir).groupBy("match_id", "tick", "team").agg(F.count(F.lit(1)).alias("n_wards"), F.max("r").alias("widest"))


@query(_PROBES + " SELECT match_id, tick, slot, team, visible, round(nearest, 4) AS nearest FROM seen")
def g7_base_visibility(spark, data_dir):
    """Whether a source of the other team covers a hero, per tick."""
    return seen(spark, data_dir).withColumn("nearest", F.round("nearest", 4))


def reveals(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, team, t, x, z): attacks by heroes on a known enemy (a hero or a ward of ``team``) whom ``team`` didn't
    see by its base sources at that tick."""
    heroes = base.roster(spark, data_dir).filter("team IS NOT NULL")
    attackers = heroes.select("match_id", "slot", (1 - F.col("team")).alias("team"))
    wards = base.wards(spark, data_dir).filter("team >= 0")
    targets = heroes.select("match_id", F.col("net_id").alias("target"), "team").unionByName(wards.select("match_id", F.col("net_id").alias("target"), "team")).distinct()
    attacks = base.anchors(spark, data_dir).filter("anchor_kind = 1 AND target > 0").withColumn("tick", F.rint("t").cast("int")).join(table(spark, data_dir, "matches", "match_id", "n_ticks"), "match_id").filter("tick < n_ticks")
    on_enemies = attacks.join(attackers, ["match_id", "slot"]).join(targets, ["match_id", "target", "team"], "left_semi")
    visible = seen(spark, data_dir, on_enemies.select("match_id", "slot", "tick")).filter("visible = 1").select("match_id", "slot", "tick")
    return on_enemies.join(visible, ["match_id", "slot", "tick"], "left_anti").select("match_id", "slot", "team", "t", "x", "z")


def reveal_spans(spark: SparkSession, data_dir: str) -> DataFrame:
    """The discs that reveals light up, for the ticks within REVEAL_S of the attack, in the shape of ``ward_spans`` with slot."""
    spread = reveals(spark, data_dir).join(table(spark, data_dir, "matches", "match_id", "n_ticks"), "match_id")
    first, last = F.ceil("t").cast("int"), F.least(F.ceil(F.col("t") + REVEAL_S) - 1, F.col("n_ticks") - 1).cast("int")
    spread = spread.withColumn("first", first).withColumn("last", last).filter("last >= first")
    return spread.select("match_id", "first", "last", "team", "x", "z", F.lit(REVEAL_RADIUS).alias("r"), F.lit("reveal").alias("class"), "slot")


def reveal_sources(spark: SparkSession, data_dir: str) -> DataFrame:
    """The same with a row for each tick, in the shape of ``sources`` with slot."""
    return per_tick(reveal_spans(spark, data_dir))


def all_spans(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, first, last, team, x, z, r, class): ``all_sources`` with one row for each stay in a place."""
    champions = champion_sources(spark, data_dir).withColumn("first", F.col("tick")).withColumnRenamed("tick", "last")
    return champions.unionByName(ward_spans(spark, data_dir)).unionByName(reveal_spans(spark, data_dir).drop("slot"))


def all_sources(spark: SparkSession, data_dir: str) -> DataFrame:
    return sources(spark, data_dir).unionByName(reveal_sources(spark, data_dir).drop("slot"))


_REVEALS = _PROBES + f""", {base.ANCHORS}, enemies AS (SELECT match_id, net_id, team FROM roster WHERE team IS NOT NULL UNION SELECT match_id, net_id, team FROM wards WHERE team >= 0),
reveals AS (SELECT a.match_id, a.slot, 1 - r.team AS team, a.t, a.x, a.z, m.n_ticks FROM anchors a JOIN matches m ON a.match_id = m.match_id JOIN roster r ON a.match_id = r.match_id AND a.slot = r.slot
 SEMI JOIN enemies e ON a.match_id = e.match_id AND a.target = e.net_id AND e.team = 1 - r.team
 ANTI JOIN (SELECT * FROM seen WHERE visible = 1) s ON a.match_id = s.match_id AND a.slot = s.slot AND CAST(round_even(a.t, 0) AS INT) = s.tick
 WHERE a.anchor_kind = 1 AND a.target > 0 AND r.team IS NOT NULL AND round_even(a.t, 0) < m.n_ticks),
reveal_sources AS (SELECT match_id, CAST(unnest(range(CAST(ceil(t) AS INT), CAST(least(ceil(t + {REVEAL_S}), n_ticks) AS INT))) AS INT) AS tick, team, x, z, {REVEAL_RADIUS} AS r, 'reveal' AS class, slot FROM reveals),
all_sources AS (SELECT * FROM sources UNION ALL SELECT match_id, tick, team, x, z, r, class FROM reveal_sources)"""


@query(_REVEALS + " SELECT match_id, tick, team, count(*) AS n_reveals, count(DISTINCT slot) AS n_heroes FROM reveal_sources GROUP BY match_id, tick, team")
def g8_reveals(spark, data_dir):
    """Attackers that give themselves away from the fog, for the ticks in which their disc is lit."""
    return reveal_sources(spark, data_dir).groupBy("match_id", "tick", "team").agg(F.count(F.lit(1)).alias("n_reveals"), F.countDistinct("slot").alias("n_heroes"))


_STREAM = _REVEALS + ", " + _masks_sql("all_sources")


@query(_STREAM + _WORDS)
def f7_team_masks(spark, data_dir):
    """What a team sees at every tick: its base sources, and the reveals on top."""
    return team_masks(all_sources(spark, data_dir))


@query(_STREAM + _AREAS)
def f9_mask_areas(spark, data_dir):
    """Cells that a team sees at every tick."""
    return mask_areas(team_masks(all_sources(spark, data_dir)))


@query(_STREAM + _COARSE)
def k5_coarse_masks(spark, data_dir):
    """What a team sees at every tick, at an eighth of the resolution, as the 64 bits of a number."""
    return coarse_masks(team_masks(all_sources(spark, data_dir)))


@query(_SOURCES + " SELECT match_id, class, team, count(*) AS n_sources, count(DISTINCT tick) AS n_ticks FROM sources GROUP BY match_id, class, team")
def g10_source_counts(spark, data_dir):
    """Sources of sight per match, team and class."""
    return sources(spark, data_dir).groupBy("match_id", "class", "team").agg(F.count(F.lit(1)).alias("n_sources"), F.countDistinct("tick").alias("n_ticks"))


def _lane_point_sql(lane: str) -> str:
    """Struct of the distance from a lane and the fraction of its length at the nearest point."""
    parts = []
    for x0, z0, x1, z1, before, whole in segments(lane):
        dx, dz = x1 - x0, z1 - z0
        f = f"greatest(0.0, least(1.0, ((x - {x0!r}) * {dx!r} + (z - {z0!r}) * {dz!r}) / {dx * dx + dz * dz!r}))"
        parts.append(f"struct_pack(d := sqrt((x - ({x0!r} + {f} * {dx!r})) * (x - ({x0!r} + {f} * {dx!r})) + (z - ({z0!r} + {f} * {dz!r})) * (z - ({z0!r} + {f} * {dz!r}))), s := ({before!r} + {f} * {math.hypot(dx, dz)!r}) / {whole!r})")
    return f"list_min([{', '.join(parts)}])"


@query(f"""WITH {base.ANCHORS}, {base.POSITIONS}, hits AS (SELECT a.match_id, p.tick, p.x, p.z FROM anchors a JOIN positions p ON a.match_id = p.match_id AND a.slot = p.slot AND CAST(round_even(a.t, 0) AS INT) = p.tick WHERE a.anchor_kind = 1),
near AS (SELECT match_id, tick, list_min([{', '.join(f"struct_pack(d := {_lane_point_sql(k)}.d, lane := '{k}', s := {_lane_point_sql(k)}.s)" for k in LANES)}]) AS n FROM hits),
c AS (SELECT match_id, n.lane AS lane, tick AS t, n.s AS s FROM near WHERE n.d <= {CONTACT_R}),
g AS (SELECT match_id, unnest(range(0, n_ticks)) AS tick FROM matches), l AS (SELECT unnest([{', '.join(f"'{k}'" for k in LANES)}]) AS lane),
k AS (SELECT g.match_id, l.lane, g.tick, sum(exp(-abs(c.t - g.tick) / {TAU})) AS w, sum(exp(-abs(c.t - g.tick) / {TAU}) * c.s) AS ws, count(c.t) AS n FROM g CROSS JOIN l LEFT JOIN c ON g.match_id = c.match_id AND l.lane = c.lane AND abs(c.t - g.tick) <= {WINDOW_S} GROUP BY g.match_id, l.lane, g.tick)
SELECT match_id, lane, CAST(tick AS INT) AS tick, n AS n_contacts, round(least({HIGH_S}, greatest({LOW_S}, (coalesce(ws, 0) + {PRIOR_W} * {PRIOR_S}) / (coalesce(w, 0) + {PRIOR_W}))), 6) AS front FROM k""")
def g11_front_line(spark, data_dir):
    """Where the front lies on each lane at each tick: heroes that attack near a lane (the tables hold no minions), smoothed
    in time by a two-sided kernel with a prior.

    A contact is spread over the ticks it can reach, so that the range join is an equality join; sums combine on the map side.
    """
    x, z = F.col("x"), F.col("z")
    hits = base.anchors(spark, data_dir).filter("anchor_kind = 1").select("match_id", "slot", F.rint("t").cast("int").alias("tick")).join(base.positions(spark, data_dir), ["match_id", "slot", "tick"])
    nearest = F.array_min(F.array(*[F.struct(lane_distance(x, z, k).alias("d"), F.lit(k).alias("lane"), lane_fraction(x, z, k).alias("s")) for k in LANES]))
    contacts = hits.select("match_id", F.col("tick").alias("t"), nearest.alias("n")).filter(F.col("n.d") <= CONTACT_R).groupBy("match_id", "n.lane", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("n.s").alias("s"))
    spread = contacts.withColumn("tick", F.explode(F.sequence(F.greatest(F.col("t") - WINDOW_S, F.lit(0)), F.col("t") + WINDOW_S)))
    w = F.exp(-F.abs(F.col("t") - F.col("tick")) / TAU)
    sums = spread.groupBy("match_id", "lane", "tick").agg(F.sum(w * F.col("n")).alias("w"), F.sum(w * F.col("s")).alias("ws"), F.sum("n").alias("n"))
    grid = table(spark, data_dir, "matches", "match_id", "n_ticks").filter("n_ticks > 0").select("match_id", F.explode(F.sequence(F.lit(0), F.col("n_ticks") - 1)).alias("tick")).withColumn("lane", F.explode(F.array(*[F.lit(k) for k in LANES])))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    front = F.least(F.lit(HIGH_S), F.greatest(F.lit(LOW_S), (zero("ws") + PRIOR_W * PRIOR_S) / (zero("w") + PRIOR_W)))
    return grid.join(sums, ["match_id", "lane", "tick"], "left").select("match_id", "lane", "tick", F.coalesce("n", F.lit(0)).alias("n_contacts"), F.round(front, 6).alias("front"))


_TICKS = f"{base.ROSTER}, {base.FOG}, {base.TRANSITIONS}, {base.TICKS}"


@query(f"WITH {_TICKS} SELECT match_id, slot, count(*) AS n_ticks, CAST(sum(visible) AS BIGINT) AS n_visible, round(avg(visible), 6) AS share FROM visible_ticks GROUP BY match_id, slot")
def q_visible_share(spark, data_dir):
    """Share of a match in which each hero was visible to the other side."""
    return base.visible_ticks(spark, data_dir).groupBy("match_id", "slot").agg(F.count(F.lit(1)).alias("n_ticks"), F.sum("visible").alias("n_visible"), F.round(F.avg("visible"), 6).alias("share"))


@query(f"WITH {_TICKS} SELECT match_id, slot, tick, visible FROM visible_ticks")
def j1_fog_at_ticks(spark, data_dir):
    """The fog record's state of each hero at each tick."""
    return base.visible_ticks(spark, data_dir).select("match_id", "slot", "tick", "visible")


#: Regions by distance: on a lane, in the river (around the middle lane's line but not on a lane), at a base.
LANE_R, RIVER_R, BASE_R = 1200.0, 3200.0, 2600.0
_HOME = [world(FOUNTAINS[k]) for k in (0, 1)]
_FOUNTAIN_D = f"least({', '.join(f'sqrt((x - {x!r}) * (x - {x!r}) + (z - {z!r}) * (z - {z!r}))' for x, z in _HOME)})"
_REGION_SQL = f"""CASE WHEN {_FOUNTAIN_D} <= {BASE_R} THEN 'base' WHEN least({lane_distance_sql('top')}, {lane_distance_sql('mid')}, {lane_distance_sql('bot')}) <= {LANE_R} THEN 'lane'
 WHEN {lane_distance_sql('mid')} <= {RIVER_R} THEN 'river' ELSE 'jungle' END"""


def region(x, z):
    to = F.least(*[distance(x, z, F.lit(a), F.lit(b)) for a, b in _HOME])
    lanes = F.least(*[lane_distance(x, z, k) for k in LANES])
    return F.when(to <= BASE_R, "base").when(lanes <= LANE_R, "lane").when(lane_distance(x, z, "mid") <= RIVER_R, "river").otherwise("jungle")


@query(f"WITH {base.POSITIONS} SELECT match_id, {_REGION_SQL} AS region, count(*) AS n_ticks FROM positions GROUP BY match_id, region")
def j2_regions(spark, data_dir):
    """Ticks of heroes per region of the map."""
    return base.positions(spark, data_dir).groupBy("match_id", region(F.col("x"), F.col("z")).alias("region")).agg(F.count(F.lit(1)).alias("n_ticks"))


_AGREE = _REVEALS + f""", {_probes_sql('all_sources', 'probes_all')}, seen_all AS (SELECT match_id, tick, slot, team, CAST(bool_or(covers) AS INT) AS visible, min(CASE WHEN class <> 'reveal' THEN d END) AS nearest FROM probes_all GROUP BY match_id, tick, slot, team),
{base.FOG}, {base.TRANSITIONS}, {base.TICKS}, agreement AS (SELECT s.match_id, s.tick, s.slot, s.team, s.visible AS ours, v.visible AS fog, s.nearest, t.tx AS x, t.tz AS z
 FROM seen_all s JOIN visible_ticks v ON s.match_id = v.match_id AND s.slot = v.slot AND s.tick = v.tick JOIN targets t ON s.match_id = t.match_id AND s.slot = t.slot AND s.tick = t.tick)"""


def agreement(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, tick, team, ours, fog, nearest, x, z): what the sources and reveals show against what the fog record
    says; nearest is the distance of the nearest base source."""
    fog = base.visible_ticks(spark, data_dir).select("match_id", "slot", "tick", F.col("visible").alias("fog"))
    ours = probes(spark, data_dir, all_sources(spark, data_dir)).groupBy("match_id", "tick", "slot", "team").agg(F.max(F.col("covers").cast("int")).alias("ours"), F.min(F.when(F.col("class") != "reveal", F.col("d"))).alias("nearest"), F.first("tx").alias("x"), F.first("tz").alias("z"))
    return ours.join(fog, ["match_id", "slot", "tick"])


@query(_AGREE + f""" SELECT match_id, {_REGION_SQL} AS region, count(*) AS n_ticks, round(avg(CASE WHEN ours = fog THEN 1.0 ELSE 0.0 END), 6) AS agree, count(*) FILTER (WHERE ours = 1 AND fog = 0) AS n_false_seen, count(*) FILTER (WHERE ours = 0 AND fog = 1) AS n_missed
FROM agreement GROUP BY match_id, region""")
def j5_fog_agreement(spark, data_dir):
    """Agreement of reconstructed sight with the fog record, per match and region."""
    same = F.when(F.col("ours") == F.col("fog"), 1.0).otherwise(0.0)
    return agreement(spark, data_dir).groupBy("match_id", region(F.col("x"), F.col("z")).alias("region")).agg(
        F.count(F.lit(1)).alias("n_ticks"), F.round(F.avg(same), 6).alias("agree"), F.count_if((F.col("ours") == 1) & (F.col("fog") == 0)).alias("n_false_seen"), F.count_if((F.col("ours") == 0) & (F.col("fog") == 1)).alias("n_missed")
    )


_AGE = f"""{base.ANCHORS}, {base.POSITIONS}, ages AS (SELECT p.match_id, p.slot, p.tick, p.tick - a.t AS age FROM positions p ASOF LEFT JOIN anchors a ON p.match_id = a.match_id AND p.slot = a.slot AND p.tick >= a.t)"""


def anchor_ages(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, tick, age): seconds since the hero's last anchor, null before the first."""
    at = base.positions(spark, data_dir).select("match_id", "slot", "tick", F.col("tick").cast("double").alias("at"))
    found = as_of(at, base.anchors(spark, data_dir), ["match_id", "slot"], "at", "t", {"t": "anchor_t"})
    return found.select("match_id", "slot", "tick", (F.col("at") - F.col("anchor_t")).alias("age"))


@query(f"WITH {_AGE} SELECT match_id, slot, count(*) AS n_ticks, count(*) FILTER (WHERE age IS NULL) AS n_before_first, round(avg(age), 4) AS mean_age, round(max(age), 4) AS oldest FROM ages GROUP BY match_id, slot")
def j6_anchor_ages(spark, data_dir):
    """How old the last anchor is at each tick of a hero."""
    return anchor_ages(spark, data_dir).groupBy("match_id", "slot").agg(F.count(F.lit(1)).alias("n_ticks"), F.count_if(F.col("age").isNull()).alias("n_before_first"), F.round(F.avg("age"), 4).alias("mean_age"), F.round(F.max("age"), 4).alias("oldest"))


@query(_PROBES + ", per AS (SELECT match_id, slot, tick, coalesce(class, 'none') AS class, min(d) AS d FROM probes GROUP BY ALL) SELECT match_id, class, count(*) AS n_ticks, round(quantile_cont(d, 0.5), 4) AS median FROM per GROUP BY match_id, class")
def j7_nearest_sources(spark, data_dir):
    """Median distance of a hero from the nearest opposing source of each class."""
    per = probes(spark, data_dir).groupBy("match_id", "slot", "tick", F.coalesce("class", F.lit("none")).alias("class")).agg(F.min("d").alias("d"))
    return per.groupBy("match_id", "class").agg(F.count(F.lit(1)).alias("n_ticks"), F.round(F.percentile("d", F.lit(0.5)), 4).alias("median"))


@query(_AGREE + """, ages AS (SELECT p.match_id, p.slot, p.tick, p.tick - a.t AS age FROM positions p ASOF LEFT JOIN anchors a ON p.match_id = a.match_id AND p.slot = a.slot AND p.tick >= a.t)
SELECT CASE WHEN age IS NULL THEN 'none' WHEN age < 0.5 THEN '0-0.5' WHEN age < 2 THEN '0.5-2' WHEN age < 5 THEN '2-5' ELSE '5+' END AS band, fog, count(*) AS n, round(avg(CASE WHEN ours = fog THEN 1.0 ELSE 0.0 END), 6) AS agree, round(quantile_cont(round(nearest, 0), 0.5), 3) AS median_nearest,
 round(avg(CASE WHEN nearest > 1350 THEN 1.0 ELSE 0.0 END), 6) AS share_far FROM agreement g JOIN ages a ON g.match_id = a.match_id AND g.slot = a.slot AND g.tick = a.tick GROUP BY band, fog""")
def j8_staleness(spark, data_dir):
    """Agreement by the age of the hero's last anchor and the fog record's state.

    Distances are rounded to whole units, so that the exact median of all rows counts few distinct values.
    """
    age = F.col("age")
    band = F.when(age.isNull(), "none").when(age < 0.5, "0-0.5").when(age < 2, "0.5-2").when(age < 5, "2-5").otherwise("5+")
    joined = agreement(spark, data_dir).join(anchor_ages(spark, data_dir), ["match_id", "slot", "tick"])
    return joined.groupBy(band.alias("band"), "fog").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("ours") == F.col("fog"), 1.0).otherwise(0.0)), 6).alias("agree"), F.round(F.percentile(F.round("nearest", 0), F.lit(0.5)), 3).alias("median_nearest"),
        F.round(F.avg(F.when(F.col("nearest") > 1350, 1.0).otherwise(0.0)), 6).alias("share_far"),
    )


@query(_AGREE + """, wrong AS (SELECT match_id, slot, tick FROM agreement WHERE ours = 1 AND fog = 0),
c AS (SELECT w.match_id, w.slot, w.tick, p.class FROM wrong w JOIN probes_all p ON w.match_id = p.match_id AND w.slot = p.slot AND w.tick = p.tick WHERE p.covers GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY match_id, slot, tick) AS k FROM c)
SELECT match_id, class, count(*) AS n_covering, count(*) FILTER (WHERE k = 1) AS n_sole FROM n GROUP BY match_id, class""")
def j9_blame(spark, data_dir):
    """Which class of source covers the heroes that we see and the fog record doesn't, and for how many it alone does."""
    classes = probes(spark, data_dir, all_sources(spark, data_dir)).groupBy("match_id", "slot", "tick").agg(F.max(F.col("covers").cast("int")).alias("ours"), F.collect_set(F.when(F.col("covers"), F.col("class"))).alias("classes"))
    fog = base.visible_ticks(spark, data_dir).filter("visible = 0").select("match_id", "slot", "tick")
    wrong = classes.filter("ours = 1").join(fog, ["match_id", "slot", "tick"])
    return wrong.select("match_id", F.explode("classes").alias("class"), (F.size("classes") == 1).alias("sole")).groupBy("match_id", "class").agg(F.count(F.lit(1)).alias("n_covering"), F.count_if("sole").alias("n_sole"))


@query(_AGREE + """, m AS (SELECT match_id, avg(CASE WHEN ours = fog THEN 1.0 ELSE 0.0 END) AS agree FROM agreement GROUP BY match_id)
SELECT count(*) AS n_matches, round(quantile_cont(agree, 0.5), 6) AS median, round(min(agree), 6) AS least, round(max(agree), 6) AS most, round(stddev_pop(agree), 6) AS spread, (SELECT count(*) FROM matches) AS n_all FROM m""")
def j14_corpus_spread(spark, data_dir):
    """Spread of the agreement over all matches."""
    per = agreement(spark, data_dir).groupBy("match_id").agg(F.avg(F.when(F.col("ours") == F.col("fog"), 1.0).otherwise(0.0)).alias("agree"))
    joined = table(spark, data_dir, "matches", "match_id").join(per, "match_id", "left")
    return joined.agg(F.count("agree").alias("n_matches"), F.round(F.percentile("agree", F.lit(0.5)), 6).alias("median"), F.round(F.min("agree"), 6).alias("least"), F.round(F.max("agree"), 6).alias("most"), F.round(F.stddev_pop("agree"), 6).alias("spread"), F.count(F.lit(1)).alias("n_all"))


@query("WITH " + _TICKS + f""", {base.POSITIONS}, h AS (SELECT p.match_id, p.tick, p.slot, r.team, p.x, p.z, v.visible FROM positions p JOIN roster r ON p.match_id = r.match_id AND p.slot = r.slot
 JOIN visible_ticks v ON p.match_id = v.match_id AND p.slot = v.slot AND p.tick = v.tick WHERE r.team IS NOT NULL AND p.tick % 2 = 0),
e AS (SELECT a.match_id, a.slot, a.tick, a.visible, a.team = b.team AS ally, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.z - b.z) * (a.z - b.z))) AS d FROM h a JOIN h b ON a.match_id = b.match_id AND a.tick = b.tick AND a.slot <> b.slot GROUP BY ALL)
SELECT ally, visible, count(*) AS n, round(quantile_cont(round(d, 0), 0.5), 3) AS median FROM e GROUP BY ally, visible""")
def j13_neighbours_by_fog_state(spark, data_dir):
    """Median distance of the nearest ally and the nearest opponent of hidden and of visible heroes, every two
    seconds; distances in whole units, so that the exact median of all rows counts few distinct values."""
    teams = base.visible_ticks(spark, data_dir).filter("team IS NOT NULL AND tick % 2 = 0").select("match_id", "slot", "tick", "team", "visible")
    h = base.positions(spark, data_dir).join(teams, ["match_id", "slot", "tick"])
    other = h.select("match_id", "tick", F.col("slot").alias("s2"), F.col("team").alias("t2"), F.col("x").alias("x2"), F.col("z").alias("z2"))
    pairs = h.join(other, ["match_id", "tick"]).filter("slot <> s2")
    near = pairs.groupBy("match_id", "slot", "tick", "visible", (F.col("team") == F.col("t2")).alias("ally")).agg(F.min(distance(F.col("x"), F.col("z"), F.col("x2"), F.col("z2"))).alias("d"))
    return near.groupBy("ally", "visible").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(F.round("d", 0), F.lit(0.5)), 3).alias("median"))


_CHAIN = ["match_id", "slot", "visible", "chain"]


def nearest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of each chain, which lies in one piece, matched one to one, nearest first, then by a and b; with their gap."""
    for found, starts in whole_groups(batches, _CHAIN):
        a, b = floats(found, "a"), floats(found, "b")
        gap, group = np.abs(a - b), np.searchsorted(starts, np.arange(found.num_rows), "right")
        used_a, used_b, keep = set(), set(), []
        order = np.lexsort((b, a, gap))
        for row, one, other in zip(order.tolist(), zip(group[order].tolist(), a[order].tolist()), zip(group[order].tolist(), b[order].tolist())):
            if one not in used_a and other not in used_b:
                used_a.add(one)
                used_b.add(other)
                keep.append(row)
        keep = np.sort(np.array(keep, np.int64))
        yield from found.append_column("gap", pa.array(gap)).take(keep).combine_chunks().to_batches()


@query()
def j4_matched_transitions(spark, data_dir):
    """Our transitions and the fog record's, matched one to one within two seconds, nearest pairs first.

    Groups are chains of candidate pairs of a hero in a match; within one the greedy choice runs over the few pairs.
    """
    order = Window.partitionBy("match_id", "slot").orderBy("tick")
    ours = seen(spark, data_dir).withColumn("before", F.coalesce(F.lag("visible").over(order), F.lit(0))).filter("visible <> before").select("match_id", "slot", F.col("tick").cast("double").alias("a"), "visible")
    fog = base.fog_transitions(spark, data_dir).select("match_id", "slot", F.col("t").alias("b"), "visible")
    # A pair at most two seconds apart shares one of two neighbouring slices of four seconds.
    left = ours.withColumn("slice", F.explode(F.array(F.floor(F.col("a") / 4), F.floor((F.col("a") + 2) / 4), F.floor((F.col("a") - 2) / 4)))).distinct()
    pairs = left.join(fog.withColumn("slice", F.floor(F.col("b") / 4)), ["match_id", "slot", "visible", "slice"]).filter("abs(a - b) <= 2.0").select("match_id", "slot", "visible", "a", "b").distinct()

    # Chains of pairs end where nothing lies within two seconds, so each chain is a group of its own. The window leaves them
    # whole and side by side in a partition, where one pass takes many at once.
    chain = Window.partitionBy(*_CHAIN[:3]).orderBy("a", "b")
    reach = F.max("b").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    marked = pairs.withColumn("new", F.coalesce((F.col("a") - F.lag("a").over(chain) > 4) & (F.least("a", "b") > reach + 4), F.lit(True)).cast("int"))
    grouped = marked.withColumn("chain", F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    matched = grouped.select(*_CHAIN, "a", "b").mapInArrow(nearest_pairs, "match_id string, slot int, visible int, chain long, a double, b double, gap double")
    counts = matched.groupBy("match_id", "slot").agg(F.count(F.lit(1)).alias("n_matched"), F.round(F.avg("gap"), 4).alias("mean_gap"), F.count_if(F.col("gap") <= 0.15).alias("n_close"))
    n_ours = ours.groupBy("match_id", "slot").agg(F.count(F.lit(1)).alias("n_ours"))
    n_fog = fog.groupBy("match_id", "slot").agg(F.count(F.lit(1)).alias("n_fog"))
    return n_ours.join(n_fog, ["match_id", "slot"], "full").join(counts, ["match_id", "slot"], "left").na.fill(0, ["n_ours", "n_fog", "n_matched", "n_close"])
