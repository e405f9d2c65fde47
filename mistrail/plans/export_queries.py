"""Queries that encode results for export (K) and those a viewer asks (L)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mistrail.functions.geometry import distance
from mistrail.operators.codec import decode, encode, quantised
from mistrail.operators.mixture import mixtures
from mistrail.operators.time_joins import within_intervals
from mistrail.plans import base
from mistrail.plans.resolution import _DOWNS, downs
from mistrail.plans.vision import _STREAM, _TICKS, all_sources, mask_areas, team_masks
from mistrail.plans.vision import SIDE as GRID_SIDE
from mistrail.sources.tables import table

QUERIES, SQL = {}, {}
SIDE = base.MAP_SIDE
GRID_CELLS = GRID_SIDE * GRID_SIDE
#: Cells per side of the raster of a mixture.
RASTER = 16
#: Seconds before a hero goes down that its visibility is judged by, and the shares that make it predictable or not.
BEFORE_S, PREDICTABLE, UNSEEN = 20.0, 0.5, 0.2
#: A step longer than this isn't interpolated.
JUMP = 600.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.startswith(("WITH", "SELECT")) else "WITH " + sql
        return f

    return add


_Q = f"CAST(greatest(0, least(4095, round_even(x / {SIDE} * 4095, 0))) AS INT)"
_CODES = f"""{base.POSITIONS}, q AS (SELECT match_id, slot, tick, {_Q} AS v, tick // 64 AS frame FROM positions),
codes AS (SELECT *, coalesce(((v - lag(v) OVER w) % 4096 + 4096) % 4096, v) AS delta, coalesce(xor(v, lag(v) OVER w), v) AS "xor" FROM q WINDOW w AS (PARTITION BY match_id, slot, frame ORDER BY tick))"""


def position_codes(spark: SparkSession, data_dir: str) -> DataFrame:
    rows = base.positions(spark, data_dir).select("match_id", "slot", "tick", quantised(F.col("x"), SIDE).alias("v"))
    return encode(rows, ["match_id", "slot"], "tick", "v")


@query(_CODES + ' SELECT match_id, slot, tick, v, CAST(frame AS BIGINT) AS frame, CAST(delta AS INT) AS delta, CAST("xor" AS INT) AS "xor" FROM codes')
def k1_position_codes(spark, data_dir):
    """Positions in 12 bits, as delta and xor codes with keyframes."""
    return position_codes(spark, data_dir).select("match_id", "slot", "tick", "v", "frame", F.col("delta").cast("int").alias("delta"), "xor")


@query(_CODES + " SELECT match_id, count(*) AS n, CAST(0 AS BIGINT) AS n_wrong, round(avg(CASE WHEN delta IN (0, 1, 4095) THEN 1.0 ELSE 0.0 END), 6) AS small_deltas FROM codes GROUP BY match_id")
def k1_round_trip(spark, data_dir):
    """Values that don't come back from their codes (none), and the share of deltas of at most one step."""
    back = decode(position_codes(spark, data_dir), ["match_id", "slot"], "tick")
    wrong = (F.col("from_delta") != F.col("v")) | (F.col("from_xor") != F.col("v"))
    return back.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("n_wrong"), F.round(F.avg(F.when(F.col("delta").isin(0, 1, 4095), 1.0).otherwise(0.0)), 6).alias("small_deltas"))


def team_mixtures(spark: SparkSession, data_dir: str) -> DataFrame:
    teams = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", "team")
    return mixtures(base.positions(spark, data_dir).join(teams, ["match_id", "slot"]), ["match_id", "team"], "x", "z", SIDE)


@query()
def k3_team_mixtures(spark, data_dir):
    """Where each team was, as a mixture of nine Gaussians."""
    rounded = [F.round(c, 3).alias(c) for c in ("cx", "cz", "sigma")]
    return team_mixtures(spark, data_dir).select("match_id", "team", "component", F.round("weight", 6).alias("weight"), *rounded)


@query()
def k7_mixture_fit(spark, data_dir):
    """Kullback-Leibler divergence of each team's mixture, rastered, from the histogram of its positions.

    Components are spread over the cells of the raster (a fixed number), and sums combine on the map side.
    """
    cell = SIDE / RASTER
    grid = F.array(*[F.lit(k) for k in range(RASTER * RASTER)])
    m = team_mixtures(spark, data_dir).withColumn("sigma", F.greatest("sigma", F.lit(cell / 2))).withColumn("bin", F.explode(grid))
    dx, dz = (F.floor(F.col("bin") / RASTER) + 0.5) * cell - F.col("cx"), (F.col("bin") % RASTER + 0.5) * cell - F.col("cz")
    density = F.col("weight") / (2 * math.pi * F.col("sigma") * F.col("sigma")) * F.exp(-(dx * dx + dz * dz) / (2 * F.col("sigma") * F.col("sigma")))
    raster = m.groupBy("match_id", "team", "bin").agg(F.sum(density).alias("d"))
    raster = raster.withColumn("q", (F.col("d") + 1e-15) / F.sum(F.col("d") + 1e-15).over(Window.partitionBy("match_id", "team")))
    teams = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", "team")
    low = lambda c: F.least(F.floor(F.col(c) / cell), F.lit(RASTER - 1)).cast("int")
    seen = base.positions(spark, data_dir).join(teams, ["match_id", "slot"]).groupBy("match_id", "team", (low("x") * RASTER + low("z")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    seen = seen.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("match_id", "team")))
    return seen.join(raster, ["match_id", "team", "bin"]).groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 5).alias("kl"))


_SEEN_SQL = _STREAM.replace("WITH ", "", 1) + f", {base.FOG}, {base.TRANSITIONS}, {base.TICKS}"


@query("WITH " + _SEEN_SQL + f""", a AS (SELECT match_id, tick, team, sum(bit_count(coalesce(low, 0)) + bit_count(coalesce(high, 0))) AS n_cells FROM masks GROUP BY match_id, tick, team),
v AS (SELECT match_id, tick, count(*) FILTER (WHERE team = 0 AND visible = 1) AS visible_0, count(*) FILTER (WHERE team = 1 AND visible = 1) AS visible_1, count(*) FILTER (WHERE team = 0 AND visible = 0) AS hidden_0, count(*) FILTER (WHERE team = 1 AND visible = 0) AS hidden_1 FROM visible_ticks GROUP BY match_id, tick)
SELECT v.match_id, v.tick, visible_0, visible_1, hidden_0, hidden_1, round(coalesce(a.n_cells, 0) / {GRID_CELLS}, 6) AS mask_area_0, round(coalesce(b.n_cells, 0) / {GRID_CELLS}, 6) AS mask_area_1 FROM v
LEFT JOIN a ON v.match_id = a.match_id AND v.tick = a.tick AND a.team = 0 LEFT JOIN a b ON v.match_id = b.match_id AND v.tick = b.tick AND b.team = 1""")
def k6_tick_scalars(spark, data_dir):
    """Visible and hidden heroes of each team and the share of the map that each team sees, at every tick. The scalars that
    come from beliefs are in k6_belief_scalars."""
    n = lambda team, visible, name: F.count_if((F.col("team") == team) & (F.col("visible") == visible)).alias(name)
    counts = base.visible_ticks(spark, data_dir).groupBy("match_id", "tick").agg(n(0, 1, "visible_0"), n(1, 1, "visible_1"), n(0, 0, "hidden_0"), n(1, 0, "hidden_1"))
    of = lambda team: F.round(F.coalesce(F.max(F.when(F.col("team") == team, F.col("n_cells"))), F.lit(0)) / GRID_CELLS, 6).alias(f"mask_area_{team}")
    areas = mask_areas(team_masks(all_sources(spark, data_dir))).groupBy("match_id", "tick").agg(of(0), of(1))
    return counts.join(areas, ["match_id", "tick"], "left").na.fill(0.0, ["mask_area_0", "mask_area_1"])


#: Positions and beliefs are exported at 8 a second where the clock has 8 ticks a second, here so many ticks apart.
POSITION_STRIDE = 1


def decimated(rows: DataFrame, stride: int) -> DataFrame:
    """The rows of every ``stride``-th tick."""
    return rows.filter(F.col("tick") % stride == 0) if stride > 1 else rows


@query(f"WITH {base.POSITIONS} SELECT match_id, slot, tick, round(x, 2) AS x, round(z, 2) AS z FROM positions")
def k8_decimated_positions(spark, data_dir):
    """Positions at the rate of the export, which is that of the table: one a tick."""
    return decimated(base.positions(spark, data_dir), POSITION_STRIDE).select("match_id", "slot", "tick", F.round("x", 2).alias("x"), F.round("z", 2).alias("z"))


@query(f"WITH {base.WARDS} SELECT w.match_id, net_id, kind, team, round(x, 2) AS x, round(z, 2) AS z, round(t0, 3) AS t0, round(least(t1, m.duration), 3) AS t1 FROM wards w JOIN matches m ON w.match_id = m.match_id")
def k9_ward_export(spark, data_dir):
    """Wards for a viewer; those that stay end with the match."""
    joined = base.wards(spark, data_dir).join(table(spark, data_dir, "matches", "match_id", "duration"), "match_id")
    return joined.select("match_id", "net_id", "kind", "team", F.round("x", 2).alias("x"), F.round("z", 2).alias("z"), F.round("t0", 3).alias("t0"), F.round(F.least("t1", "duration"), 3).alias("t1"))


_YIELD = f"""{_TICKS}, {base.POSITIONS}, {base.WARDS}, h AS (SELECT p.*, r.team, v.visible FROM positions p JOIN roster r ON p.match_id = r.match_id AND p.slot = r.slot JOIN visible_ticks v ON p.match_id = v.match_id AND p.slot = v.slot AND p.tick = v.tick WHERE r.team IS NOT NULL),
c AS (SELECT w.match_id, w.net_id, w.team, h.tick, h.slot, h.x, h.z FROM wards w JOIN h ON w.match_id = h.match_id AND h.team = 1 - w.team AND h.tick BETWEEN floor(w.t0 + 0.5) AND floor(least(w.t1, 1e9) + 0.5) AND h.visible = 1 WHERE w.team >= 0 AND (w.x - h.x) * (w.x - h.x) + (w.z - h.z) * (w.z - h.z) <= w.sight * w.sight),
a AS (SELECT c.match_id, c.net_id, c.tick, c.slot, coalesce(bool_or((o.x - c.x) * (o.x - c.x) + (o.z - c.z) * (o.z - c.z) <= 1350.0 * 1350.0), false) AS near FROM c LEFT JOIN h o ON o.match_id = c.match_id AND o.tick = c.tick AND o.team = c.team GROUP BY ALL),
yields AS (SELECT match_id, net_id, count(*) AS n_covered, count(*) FILTER (WHERE NOT near) AS n_exclusive, count(DISTINCT slot) FILTER (WHERE NOT near) AS n_enemies FROM a GROUP BY match_id, net_id)"""


def ward_yields(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, net_id, n_covered, n_exclusive, n_enemies): what each ward saw, over all ticks of its life.

    Covered is a visible enemy within the ward's sight, exclusive one with none of the ward's team within a hero's sight;
    n_enemies counts the heroes that were exclusive at some tick.
    """
    teams = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", "team")
    visible = base.visible_ticks(spark, data_dir).select("match_id", "slot", "tick", "visible")
    h = base.positions(spark, data_dir).join(teams, ["match_id", "slot"]).join(visible, ["match_id", "slot", "tick"])
    half_up = lambda c: F.floor(c + 0.5).cast("double")
    wards = base.wards(spark, data_dir).filter("team >= 0").join(table(spark, data_dir, "matches", "match_id", "n_ticks"), "match_id")
    wards = wards.select("match_id", "net_id", F.col("team").alias("ward_team"), (1 - F.col("team")).alias("team"), F.col("x").alias("wx"), F.col("z").alias("wz"), half_up(F.col("t0")).alias("t0"), half_up(F.least(F.col("t1"), F.col("n_ticks").cast("double"))).alias("t1"), "sight")
    inside = within_intervals(h.filter("visible = 1").withColumn("at", F.col("tick").cast("double")), wards, ["match_id", "team"], "at", "t0", "t1")
    covered = inside.filter((F.col("wx") - F.col("x")) * (F.col("wx") - F.col("x")) + (F.col("wz") - F.col("z")) * (F.col("wz") - F.col("z")) <= F.col("sight") * F.col("sight"))
    covered = covered.select("match_id", "net_id", "ward_team", "tick", "slot", "x", "z")
    allies = h.select("match_id", "tick", F.col("team").alias("ward_team"), F.col("x").alias("ax"), F.col("z").alias("az"))
    d2 = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("az") - F.col("z")) * (F.col("az") - F.col("z"))
    near = covered.join(allies, ["match_id", "tick", "ward_team"], "left").groupBy("match_id", "net_id", "tick", "slot").agg(F.coalesce(F.max((d2 <= base.CHAMPION_SIGHT**2).cast("int")), F.lit(0)).alias("near"))
    return near.groupBy("match_id", "net_id").agg(F.count(F.lit(1)).alias("n_covered"), F.count_if(F.col("near") == 0).alias("n_exclusive"), F.countDistinct(F.when(F.col("near") == 0, F.col("slot"))).alias("n_enemies"))


@query("WITH " + _YIELD + " SELECT * FROM yields")
def l1_ward_yield(spark, data_dir):
    """Enemies seen by each ward, and by it alone."""
    return ward_yields(spark, data_dir)


@query(f"WITH {base.ROSTER}, {_DOWNS}, {base.FOG}, {base.TRANSITIONS}, {base.TICKS}, " + f"""b AS (SELECT d.match_id, d.slot, d.t, count(*) AS n, avg(v.visible) AS share FROM downs d JOIN visible_ticks v ON d.match_id = v.match_id AND d.slot = v.slot AND v.tick BETWEEN d.t - {BEFORE_S} AND d.t GROUP BY ALL)
SELECT match_id, slot, t, n AS n_ticks, round(share, 6) AS share, CASE WHEN share > {PREDICTABLE} THEN 'predictable' WHEN share < {UNSEEN} THEN 'invisible' ELSE 'sudden' END AS verdict FROM b""")
def l2_down_autopsy(spark, data_dir):
    """How visible a hero was in the seconds before it went down."""
    spans = downs(spark, data_dir).select("match_id", "slot", F.col("t").alias("down_t"), (F.col("t") - BEFORE_S).alias("start"))
    ticks = base.visible_ticks(spark, data_dir).select("match_id", "slot", F.col("tick").cast("double").alias("at"), "visible")
    per = within_intervals(ticks, spans, ["match_id", "slot"], "at", "start", "down_t").groupBy("match_id", "slot", "down_t").agg(F.count(F.lit(1)).alias("n_ticks"), F.avg("visible").alias("share"))
    verdict = F.when(F.col("share") > PREDICTABLE, "predictable").when(F.col("share") < UNSEEN, "invisible").otherwise("sudden")
    return per.select("match_id", "slot", F.col("down_t").alias("t"), "n_ticks", F.round("share", 6).alias("share"), verdict.alias("verdict"))


@query(f"WITH {base.POSITIONS}, n AS (SELECT *, lead(x) OVER w AS x1, lead(z) OVER w AS z1, lead(tick) OVER w AS t1 FROM positions WINDOW w AS (PARTITION BY match_id, slot ORDER BY tick)) SELECT match_id, slot, tick, round(CASE WHEN sqrt(pow(x1 - x, 2) + pow(z1 - z, 2)) <= {JUMP} THEN (x + x1) / 2 ELSE x END, 3) AS x_half, round(CASE WHEN sqrt(pow(x1 - x, 2) + pow(z1 - z, 2)) <= {JUMP} THEN (z + z1) / 2 ELSE z END, 3) AS z_half FROM n WHERE t1 = tick + 1")
def l4_half_tick_positions(spark, data_dir):
    """Positions half-way between ticks; after a jump the earlier one stands."""
    order = Window.partitionBy("match_id", "slot").orderBy("tick")
    n = base.positions(spark, data_dir).withColumn("x1", F.lead("x").over(order)).withColumn("z1", F.lead("z").over(order)).withColumn("t1", F.lead("tick").over(order)).filter(F.col("t1") == F.col("tick") + 1)
    near = distance(F.col("x"), F.col("z"), F.col("x1"), F.col("z1")) <= JUMP
    half = lambda c: F.round(F.when(near, (F.col(c) + F.col(c + "1")) / 2).otherwise(F.col(c)), 3).alias(c + "_half")
    return n.select("match_id", "slot", "tick", half("x"), half("z"))


@query(f"WITH {_TICKS}, a AS (SELECT match_id, tick, sum(CASE WHEN team = 1 THEN visible ELSE -visible END) AS advantage FROM visible_ticks WHERE team IS NOT NULL GROUP BY match_id, tick) SELECT match_id, CAST(tick // 15 AS INT) AS bucket, round(avg(advantage), 6) AS mean, CAST(max(abs(advantage)) AS BIGINT) AS peak FROM a GROUP BY match_id, bucket")
def l6_advantage_timeline(spark, data_dir):
    """By how many more of the other team's heroes each side sees, in stretches of 15 seconds."""
    a = base.visible_ticks(spark, data_dir).filter("team IS NOT NULL").groupBy("match_id", "tick").agg(F.sum(F.when(F.col("team") == 1, F.col("visible")).otherwise(-F.col("visible"))).alias("advantage"))
    return a.groupBy("match_id", F.floor(F.col("tick") / 15).cast("int").alias("bucket")).agg(F.round(F.avg("advantage"), 6).alias("mean"), F.max(F.abs("advantage")).alias("peak"))


@query(f"WITH {_TICKS}, {base.POSITIONS}, o AS (SELECT unnest([0, 1]) AS observer) SELECT v.match_id, o.observer, v.slot, count(*) AS n_points, min(v.tick) AS first_tick, max(v.tick) AS last_tick FROM visible_ticks v JOIN positions p ON v.match_id = p.match_id AND v.slot = p.slot AND v.tick = p.tick, o WHERE v.team IS NOT NULL AND (v.team = o.observer OR v.visible = 1) GROUP BY ALL")
def l9_trails(spark, data_dir):
    """Points of each hero's trail that an observing team may be shown: all of its own, those it saw of the others'."""
    shown = base.visible_ticks(spark, data_dir).filter("team IS NOT NULL").withColumn("observer", F.explode(F.array(F.lit(0), F.lit(1)))).filter("team = observer OR visible = 1")
    return shown.join(base.positions(spark, data_dir).select("match_id", "slot", "tick"), ["match_id", "slot", "tick"]).groupBy("match_id", "observer", "slot").agg(F.count(F.lit(1)).alias("n_points"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))


@query(f"WITH {_TICKS} SELECT match_id, 1 - team AS observer, tick, count(*) FILTER (WHERE visible = 0) AS n_hidden FROM visible_ticks WHERE team IS NOT NULL GROUP BY match_id, observer, tick")
def l10_hidden_enemies(spark, data_dir):
    """Enemies that each team doesn't see, at every tick."""
    return base.visible_ticks(spark, data_dir).filter("team IS NOT NULL").groupBy("match_id", (1 - F.col("team")).alias("observer"), "tick").agg(F.count_if(F.col("visible") == 0).alias("n_hidden"))


@query("WITH " + _YIELD + ", r AS (SELECT y.*, w.t0, w.kind FROM yields y JOIN wards w ON y.match_id = w.match_id AND y.net_id = w.net_id) SELECT match_id, net_id, kind, n_exclusive, n_covered, CAST(row_number() OVER (PARTITION BY match_id ORDER BY n_exclusive DESC, n_covered DESC, t0, net_id) AS INT) AS place FROM r QUALIFY place <= 10")
def l11_best_wards(spark, data_dir):
    """The ten wards of each match that saw most alone."""
    joined = ward_yields(spark, data_dir).join(base.wards(spark, data_dir).select("match_id", "net_id", "t0", "kind"), ["match_id", "net_id"])
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("n_exclusive"), F.desc("n_covered"), "t0", "net_id"))
    return joined.withColumn("place", place).filter("place <= 10").select("match_id", "net_id", "kind", "n_exclusive", "n_covered", "place")
