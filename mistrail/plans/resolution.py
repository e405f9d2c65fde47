"""Queries that resolve who did what (D), and geometry along the way (E)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mistrail.functions.geometry import FOUNTAINS, LANES, MIN_X, MIN_Z, cell, distance, lane_distance, lane_distance_sql, segments, world
from mistrail.operators.time_joins import as_of, within_intervals
from mistrail.plans import base
from mistrail.plans.packet_log import _ATTACKS, _WAYPOINTS, attribute_sql, attribute_values, hero_attacks, waypoints
from mistrail.sources.tables import table

QUERIES, SQL = {}, {}
#: Seconds beyond its first and last anchor for which a slot's skeleton still counts.
REACH_S = 2.0
#: How far an order may start from the skeleton: so much, more per second between the two anchors around it (of so many
#: seconds at most), and at most.
GATE, GATE_PER_S, GATE_S, FARTHEST = 400.0, 200.0, 30.0, 3000.0
#: Health at or below which a hero counts as down, seconds in which a further packet tells of the same event, and seconds
#: before it in which attacks are looked at. The given tables hold no zero health, so there are no downs in them.
LOW_HEALTH, SAME_EVENT_S, ATTACK_S = 0.0, 3.0, 5.0
#: Attacks between two heroes that count as evidence, and the share of attacks that a split must cut to be trusted.
LEAST_ATTACKS, LEAST_CUT = 3, 0.9
#: Seconds of the match in which roles are read from positions.
LANING_S = (90, 600)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def owned_orders(spark: SparkSession, data_dir: str) -> DataFrame:
    return table(spark, data_dir, "move_order", "match_id", "order_no", "t", "owner").filter("owner >= 0").distinct().withColumnRenamed("owner", "slot")


@query(f"""WITH {base.ANCHORS}, o AS (SELECT DISTINCT match_id, order_no, t, owner AS slot FROM move_order WHERE owner >= 0),
b AS (SELECT o.*, a.t AS t0, a.x AS x0, a.z AS z0 FROM o ASOF LEFT JOIN anchors a ON o.match_id = a.match_id AND o.slot = a.slot AND o.t >= a.t),
f AS (SELECT b.*, a.t AS t1, a.x AS x1, a.z AS z1 FROM b ASOF LEFT JOIN anchors a ON b.match_id = a.match_id AND b.slot = a.slot AND b.t <= a.t)
SELECT match_id, order_no, slot, round(CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL OR t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / (t1 - t0) END, 4) AS x,
round(CASE WHEN t0 IS NULL THEN z1 WHEN t1 IS NULL OR t1 = t0 THEN z0 ELSE z0 + (z1 - z0) * (t - t0) / (t1 - t0) END, 4) AS z,
round(t1 - t0, 6) AS gap, coalesce(t0 IS NULL AND t1 - t > 2 OR t1 IS NULL AND t - t0 > 2 OR t0 IS NULL AND t1 IS NULL, false) AS out_of_range FROM f""")
def d1_order_skeleton(spark, data_dir):
    """Where the owner of each order was by its anchors: interpolated, with the gap between the two anchors."""
    anchors = base.anchors(spark, data_dir)
    back = as_of(owned_orders(spark, data_dir), anchors, ["match_id", "slot"], "t", "t", {"t": "t0", "x": "x0", "z": "z0"})
    both = as_of(back, anchors, ["match_id", "slot"], "t", "t", {"t": "t1", "x": "x1", "z": "z1"}, forward=True)
    at = lambda c: F.when(F.col("t0").isNull(), F.col(c + "1")).when(F.col("t1").isNull() | (F.col("t1") == F.col("t0")), F.col(c + "0")).otherwise(F.col(c + "0") + (F.col(c + "1") - F.col(c + "0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    out = (F.col("t0").isNull() & (F.col("t1") - F.col("t") > REACH_S)) | (F.col("t1").isNull() & (F.col("t") - F.col("t0") > REACH_S)) | (F.col("t0").isNull() & F.col("t1").isNull())
    return both.select("match_id", "order_no", "slot", F.round(at("x"), 4).alias("x"), F.round(at("z"), 4).alias("z"), F.round(F.col("t1") - F.col("t0"), 6).alias("gap"), F.coalesce(out, F.lit(False)).alias("out_of_range"))


@query(f"""WITH {base.ANCHORS}, o AS (SELECT DISTINCT match_id, order_no, t, owner AS slot FROM move_order WHERE owner >= 0), p AS (SELECT *, t - 0.5 AS u, -1 AS side FROM o UNION ALL SELECT *, t + 0.5, 1 FROM o),
b AS (SELECT p.*, a.t AS t0, a.x AS x0, a.z AS z0 FROM p ASOF LEFT JOIN anchors a ON p.match_id = a.match_id AND p.slot = a.slot AND p.u >= a.t),
f AS (SELECT b.*, a.t AS t1, a.x AS x1, a.z AS z1 FROM b ASOF LEFT JOIN anchors a ON b.match_id = a.match_id AND b.slot = a.slot AND b.u <= a.t),
i AS (SELECT match_id, order_no, slot, side, CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL OR t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (u - t0) / (t1 - t0) END AS x,
 CASE WHEN t0 IS NULL THEN z1 WHEN t1 IS NULL OR t1 = t0 THEN z0 ELSE z0 + (z1 - z0) * (u - t0) / (t1 - t0) END AS z FROM f)
SELECT match_id, order_no, slot, round(sum(side * x), 4) AS dx, round(sum(side * z), 4) AS dz FROM i GROUP BY match_id, order_no, slot""")
def d3_order_heading(spark, data_dir):
    """Displacement of each order's owner from half a second before to half a second after it."""
    orders, anchors = owned_orders(spark, data_dir), base.anchors(spark, data_dir)
    probes = orders.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("u", F.col("t") + 0.5 * F.col("side"))
    back = as_of(probes, anchors, ["match_id", "slot"], "u", "t", {"t": "t0", "x": "x0", "z": "z0"})
    both = as_of(back, anchors, ["match_id", "slot"], "u", "t", {"t": "t1", "x": "x1", "z": "z1"}, forward=True)
    at = lambda c: F.when(F.col("t0").isNull(), F.col(c + "1")).when(F.col("t1").isNull() | (F.col("t1") == F.col("t0")), F.col(c + "0")).otherwise(F.col(c + "0") + (F.col(c + "1") - F.col(c + "0")) * (F.col("u") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return both.groupBy("match_id", "order_no", "slot").agg(F.round(F.sum(F.col("side") * at("x")), 4).alias("dx"), F.round(F.sum(F.col("side") * at("z")), 4).alias("dz"))


def order_costs(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, line_id, event_no, t, slot, cost): distance of each order's first point from the skeleton of each hero of
    the match at that time, where that is within the gate and the skeleton's reach."""
    starts = waypoints(spark, data_dir).filter("point_no = 0 AND t IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL").select("match_id", "line_id", "event_no", "t", F.col("x").alias("sx"), F.col("z").alias("sz"))
    pairs = starts.join(base.roster(spark, data_dir).select("match_id", "slot"), "match_id")
    order = Window.partitionBy("match_id", "slot").orderBy("t")
    anchors = base.anchors(spark, data_dir).select("match_id", "slot", "t", "x", "z", F.coalesce(F.lead("t").over(order) - F.col("t"), F.col("t") - F.lag("t").over(order)).alias("gap"))
    back = as_of(pairs, anchors, ["match_id", "slot"], "t", "t", {"t": "t0", "x": "x0", "z": "z0", "gap": "gap0"})
    both = as_of(back, anchors, ["match_id", "slot"], "t", "t", {"t": "t1", "x": "x1", "z": "z1", "gap": "gap1"}, forward=True)
    at = lambda c: F.when(F.col("t0").isNull(), F.col(c + "1")).when(F.col("t1").isNull() | (F.col("t1") == F.col("t0")), F.col(c + "0")).otherwise(F.col(c + "0") + (F.col(c + "1") - F.col(c + "0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    inside = F.when(F.col("t0").isNull(), F.col("t1") - F.col("t") <= REACH_S).otherwise(F.col("t1").isNotNull() | (F.col("t") - F.col("t0") <= REACH_S))
    gap = F.coalesce(F.when(F.col("t0").isNull(), F.col("gap1")).otherwise(F.col("gap0")), F.lit(GATE_S))
    gate = F.least(F.lit(FARTHEST), GATE + GATE_PER_S * F.least(gap, F.lit(GATE_S)))
    costs = both.filter(inside).withColumn("cost", distance(at("x"), at("z"), F.col("sx"), F.col("sz"))).filter(F.col("cost") <= gate)
    return costs.select("match_id", "line_id", "event_no", "t", "slot", "cost")


_COSTS = _WAYPOINTS + f""", {base.ROSTER}, {base.ANCHORS}, gaps AS (SELECT match_id, slot, t, x, z, coalesce(lead(t) OVER w - t, t - lag(t) OVER w) AS gap FROM anchors WINDOW w AS (PARTITION BY match_id, slot ORDER BY t)),
pairs0 AS (SELECT w.match_id, w.line_id, w.event_no, w.t, r.slot, w.x AS sx, w.z AS sz FROM waypoints w JOIN roster r ON w.match_id = r.match_id WHERE w.point_no = 0 AND w.t IS NOT NULL AND w.x IS NOT NULL AND w.z IS NOT NULL),
back AS (SELECT p.*, a.t AS t0, a.x AS x0, a.z AS z0, a.gap AS gap0 FROM pairs0 p ASOF LEFT JOIN gaps a ON p.match_id = a.match_id AND p.slot = a.slot AND p.t >= a.t),
ahead AS (SELECT b.*, a.t AS t1, a.x AS x1, a.z AS z1, a.gap AS gap1 FROM back b ASOF LEFT JOIN gaps a ON b.match_id = a.match_id AND b.slot = a.slot AND b.t <= a.t),
placed0 AS (SELECT *, CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL OR t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / (t1 - t0) END AS x,
 CASE WHEN t0 IS NULL THEN z1 WHEN t1 IS NULL OR t1 = t0 THEN z0 ELSE z0 + (z1 - z0) * (t - t0) / (t1 - t0) END AS z,
 least({FARTHEST}, {GATE} + {GATE_PER_S} * least(coalesce(CASE WHEN t0 IS NULL THEN gap1 ELSE gap0 END, {GATE_S}), {GATE_S})) AS gate FROM ahead
 WHERE CASE WHEN t0 IS NULL THEN t1 - t <= {REACH_S} ELSE t1 IS NOT NULL OR t - t0 <= {REACH_S} END),
costs AS (SELECT match_id, line_id, event_no, t, slot, sqrt((x - sx) * (x - sx) + (z - sz) * (z - sz)) AS cost FROM placed0 WHERE sqrt((x - sx) * (x - sx) + (z - sz) * (z - sz)) <= gate)"""


@query(_COSTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY match_id, line_id, event_no ORDER BY cost, slot) AS rn FROM costs)
SELECT match_id, line_id, event_no, CAST(max(CASE WHEN rn = 1 THEN slot END) AS INT) AS slot, round(max(CASE WHEN rn = 1 THEN cost END), 4) AS cost,
 coalesce(round(max(CASE WHEN rn = 2 THEN cost END) - max(CASE WHEN rn = 1 THEN cost END), 4), CAST('Infinity' AS DOUBLE)) AS margin
FROM r WHERE rn <= 2 GROUP BY match_id, line_id, event_no""")
def d5_order_owner_margin(spark, data_dir):
    """The hero whose skeleton is nearest to the start of each order, and by how much it is nearer than the next (infinite if there is none)."""
    best = Window.partitionBy("match_id", "line_id", "event_no").orderBy("cost", "slot")
    two = order_costs(spark, data_dir).withColumn("rn", F.row_number().over(best)).filter("rn <= 2")
    first = F.max(F.when(F.col("rn") == 1, F.col("cost")))
    margin = F.coalesce(F.round(F.max(F.when(F.col("rn") == 2, F.col("cost"))) - first, 4), F.lit(float("inf")))
    return two.groupBy("match_id", "line_id", "event_no").agg(F.max(F.when(F.col("rn") == 1, F.col("slot"))).alias("slot"), F.round(first, 4).alias("cost"), margin.alias("margin"))


@query(_COSTS + """, instants AS (SELECT match_id, t, list_sort(list(struct_pack(cost := cost, line_id := line_id, event_no := event_no, slot := slot))) AS ps FROM costs GROUP BY match_id, t),
folded AS (SELECT match_id, t, list_reduce(list_transform(ps, lambda p: [p]), lambda kept, p: CASE WHEN len(list_filter(kept, lambda k: (k.line_id = p[1].line_id AND k.event_no = p[1].event_no) OR k.slot = p[1].slot)) > 0 THEN kept ELSE list_append(kept, p[1]) END) AS kept FROM instants),
flat AS (SELECT match_id, t, unnest(kept) AS k FROM folded)
SELECT match_id, k.line_id AS line_id, k.event_no AS event_no, t, k.slot AS slot, round(k.cost, 4) AS cost FROM flat""")
def d6_joint_owners(spark, data_dir):
    """Owners of orders, one hero for each of the orders of one instant: the cheapest pairs first.

    The pairs of an instant (at most ten per order) are folded in order of cost; a pair counts if neither its order nor
    its hero is taken.
    """
    pair = F.struct("cost", "line_id", "event_no", "slot")
    instants = order_costs(spark, data_dir).groupBy("match_id", "t").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    taken = F.aggregate(
        "pairs", F.filter("pairs", lambda p: F.lit(False)),
        lambda kept, p: F.when(F.exists(kept, lambda k: ((k["line_id"] == p["line_id"]) & (k["event_no"] == p["event_no"])) | (k["slot"] == p["slot"])), kept).otherwise(F.concat(kept, F.array(p))),
    )
    return instants.select("match_id", "t", F.inline(taken)).select("match_id", "line_id", "event_no", "t", "slot", F.round("cost", 4).alias("cost"))


@query("""SELECT match_id, count(*) AS n_orders, round(quantile_cont(order_residual, 0.5), 4) AS median, round(quantile_cont(order_residual, 0.99), 4) AS p99, round(max(order_residual), 4) AS largest
FROM (SELECT DISTINCT match_id, order_no, order_residual FROM move_order WHERE owner >= 0 AND isfinite(order_residual) AND order_residual >= 0) GROUP BY match_id""")
def d11_order_residuals(spark, data_dir):
    """Percentiles of the orders' residuals per match."""
    rows = table(spark, data_dir, "move_order").filter("owner >= 0 AND order_residual >= 0 AND NOT isnan(order_residual) AND order_residual < double('Infinity')").select("match_id", "order_no", "order_residual").distinct()
    return rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.percentile("order_residual", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("order_residual", F.lit(0.99)), 4).alias("p99"), F.round(F.max("order_residual"), 4).alias("largest"))


@query(f"""WITH {base.ANCHORS}, {base.POSITIONS}, r AS (SELECT a.match_id, sqrt((a.x - p.x) * (a.x - p.x) + (a.z - p.z) * (a.z - p.z)) AS d FROM anchors a JOIN positions p ON a.match_id = p.match_id AND a.slot = p.slot AND CAST(floor(a.t) AS INT) = p.tick)
SELECT match_id, count(*) AS n_anchors, round(quantile_cont(d, 0.5), 4) AS median, round(quantile_cont(d, 0.99), 4) AS p99, round(max(d), 4) AS largest FROM r GROUP BY match_id""")
def d11_anchor_residuals(spark, data_dir):
    """Percentiles of the distance between anchors and the trajectory."""
    anchors = base.anchors(spark, data_dir).select("match_id", "slot", F.floor("t").cast("int").alias("tick"), F.col("x").alias("ax"), F.col("z").alias("az"))
    d = anchors.join(base.positions(spark, data_dir), ["match_id", "slot", "tick"]).select("match_id", distance(F.col("x"), F.col("z"), F.col("ax"), F.col("az")).alias("d"))
    return d.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_anchors"), F.round(F.percentile("d", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("d", F.lit(0.99)), 4).alias("p99"), F.round(F.max("d"), 4).alias("largest"))


@query("SELECT match_id, count(*) AS n_orders, count(*) FILTER (WHERE owner >= 0) AS n_owned, round(count(*) FILTER (WHERE owner >= 0) / count(*), 6) AS rate FROM (SELECT DISTINCT match_id, order_no, owner FROM move_order) GROUP BY match_id")
def d12_attribution_rate(spark, data_dir):
    """Share of orders with an owner."""
    owned = F.count_if(F.col("owner") >= 0)
    return table(spark, data_dir, "move_order", "match_id", "order_no", "owner").distinct().groupBy("match_id").agg(F.count(F.lit(1)).alias("n_orders"), owned.alias("n_owned"), F.round(owned / F.count(F.lit(1)), 6).alias("rate"))


def pair_weights(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, a, b, n) with a < b: attacks between two heroes, in either direction, LEAST_ATTACKS of them or more."""
    attacks = hero_attacks(spark, data_dir).filter("source <> target")
    return attacks.groupBy("match_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_ATTACKS)


_PAIRS = _ATTACKS + f", pairs AS (SELECT match_id, least(source, target) AS a, greatest(source, target) AS b, count(*) AS n FROM attacks WHERE source <> target GROUP BY ALL HAVING count(*) >= {LEAST_ATTACKS})"
_CUTS = _PAIRS + """, sides AS (SELECT match_id, CAST(bit_or(CAST(1 AS BIGINT) << slot) AS BIGINT) AS every, min(slot) AS low FROM roster GROUP BY match_id),
cuts AS (SELECT p.match_id, m.m, sum(CASE WHEN ((m >> a) & 1) <> ((m >> b) & 1) THEN n ELSE 0 END) AS cut, sum(n) AS total
 FROM pairs p JOIN sides s ON p.match_id = s.match_id JOIN range(1, 1024) m(m) ON (m & s.every) = m AND 2 * bit_count(m) = bit_count(s.every) AND ((m >> s.low) & 1) = 1 GROUP BY p.match_id, m.m),
top AS (SELECT *, max(cut) OVER (PARTITION BY match_id) AS most FROM cuts),
splits AS (SELECT match_id, CAST(min(m) AS BIGINT) AS mask, CAST(max(cut) AS BIGINT) AS cut, CAST(max(total) AS BIGINT) AS total, count(*) = 1 AS resolved FROM top WHERE cut = most GROUP BY match_id)"""


def max_cuts(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, mask, cut, total, resolved): the even split of a match's heroes that cuts most attacks.

    Each pair of heroes is spread over the splits with the first slot on the first side (126 for ten heroes); sums combine
    on the map side. A match with an odd number of heroes has none; several best ones leave it unresolved.
    """
    sides = base.roster(spark, data_dir).groupBy("match_id").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("every"), F.min("slot").alias("low"))
    fits = lambda m: ((m.bitwiseAND(F.col("every")) == m) & (2 * F.bit_count(m) == F.bit_count("every")) & (F.getbit(m, F.col("low")) == 1))
    splits = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(1023).cast("long")), fits)
    spread = pair_weights(spark, data_dir).join(sides.select("match_id", splits.alias("masks")), "match_id").select("match_id", "a", "b", "n", F.explode("masks").alias("mask"))
    apart = F.getbit("mask", F.col("a")) != F.getbit("mask", F.col("b"))
    cuts = spread.groupBy("match_id", "mask").agg(F.sum(F.when(apart, F.col("n")).otherwise(0)).alias("cut"), F.sum("n").alias("total"))
    best = cuts.withColumn("top", F.max("cut").over(Window.partitionBy("match_id"))).filter("cut = top")
    return best.groupBy("match_id").agg(F.min("mask").alias("mask"), F.max("cut").alias("cut"), F.max("total").alias("total"), (F.count(F.lit(1)) == 1).alias("resolved"))


@query(_CUTS + " SELECT match_id, mask, cut, total, round(cut / total, 6) AS share, resolved FROM splits")
def d13_max_cut(spark, data_dir):
    """The split of a match's heroes into two halves that cuts most attacks; unresolved if several do."""
    return max_cuts(spark, data_dir).select("match_id", "mask", "cut", "total", F.round(F.col("cut") / F.col("total"), 6).alias("share"), "resolved")


(_AX, _AZ), (_BX, _BZ) = world(FOUNTAINS[0]), world(FOUNTAINS[1])
_LEAN = f"""{base.ANCHORS}, early AS (SELECT * FROM anchors QUALIFY row_number() OVER (PARTITION BY match_id, slot ORDER BY t) <= 5),
mids AS (SELECT match_id, slot, quantile_cont(x, 0.5) AS x, quantile_cont(z, 0.5) AS z FROM early GROUP BY match_id, slot),
leans AS (SELECT match_id, slot, sqrt((x - {_BX!r}) * (x - {_BX!r}) + (z - {_BZ!r}) * (z - {_BZ!r})) - sqrt((x - {_AX!r}) * (x - {_AX!r}) + (z - {_AZ!r}) * (z - {_AZ!r})) AS lean FROM mids)"""


def leans(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, lean): by how much nearer a hero began to team 0's fountain than to team 1's."""
    early = base.anchors(spark, data_dir).withColumn("rn", F.row_number().over(Window.partitionBy("match_id", "slot").orderBy("t"))).filter("rn <= 5")
    mid = early.groupBy("match_id", "slot").agg(F.percentile("x", F.lit(0.5)).alias("x"), F.percentile("z", F.lit(0.5)).alias("z"))
    to = lambda x, z: distance(F.col("x"), F.col("z"), F.lit(x), F.lit(z))
    return mid.select("match_id", "slot", (to(_BX, _BZ) - to(_AX, _AZ)).alias("lean"))


@query(f"WITH {_LEAN} SELECT match_id, slot, round(lean, 4) AS lean FROM leans")
def d14_geometric_lean(spark, data_dir):
    """Lean of each hero by the median of its first five anchors."""
    return leans(spark, data_dir).select("match_id", "slot", F.round("lean", 4).alias("lean"))


@query(_CUTS + f""", {_LEAN}, h AS (SELECT r.match_id, r.slot, l.lean, s.mask, s.resolved AND s.cut >= {LEAST_CUT} * s.total AS by_cut FROM roster r LEFT JOIN leans l ON r.match_id = l.match_id AND r.slot = l.slot LEFT JOIN splits s ON r.match_id = s.match_id),
k AS (SELECT *, CASE WHEN by_cut THEN CAST((mask >> slot) & 1 AS INT) END AS side, count(*) OVER w AS n, count(lean) OVER w AS n_lean, row_number() OVER (PARTITION BY match_id ORDER BY lean DESC NULLS LAST, slot) AS place FROM h WINDOW w AS (PARTITION BY match_id)),
o AS (SELECT *, coalesce(avg(CASE WHEN side = 1 THEN lean END) OVER w < avg(CASE WHEN side = 0 THEN lean END) OVER w, false) AS turned FROM k WINDOW w AS (PARTITION BY match_id))
SELECT match_id, slot, CAST(CASE WHEN side IS NOT NULL THEN CASE WHEN (side = 1) <> turned THEN 0 ELSE 1 END WHEN n_lean = n AND n % 2 = 0 THEN CASE WHEN 2 * place <= n THEN 0 ELSE 1 END
 WHEN lean IS NULL THEN -1 WHEN lean > 0 THEN 0 ELSE 1 END AS INT) AS team,
 CASE WHEN side IS NOT NULL THEN 'cut' WHEN n_lean = n AND n % 2 = 0 THEN 'rank' WHEN n_lean > 0 THEN 'sign' ELSE 'none' END AS method FROM o""")
def d15_teams(spark, data_dir):
    """Teams of the heroes: the two sides of a best split that cuts nearly all attacks, turned so that team 0 is the side
    that leans more to team 0's fountain; else the half that leans most to it, or, where a hero has no lean, its sign."""
    split = max_cuts(spark, data_dir).select("match_id", "mask", (F.col("resolved") & (F.col("cut") >= LEAST_CUT * F.col("total"))).alias("by_cut"))
    h = base.roster(spark, data_dir).select("match_id", "slot").join(leans(spark, data_dir), ["match_id", "slot"], "left").join(split, "match_id", "left")
    match = Window.partitionBy("match_id")
    h = h.withColumn("side", F.when(F.col("by_cut"), F.getbit("mask", F.col("slot")).cast("int"))).withColumn("n", F.count(F.lit(1)).over(match)).withColumn("n_lean", F.count("lean").over(match))
    h = h.withColumn("place", F.row_number().over(match.orderBy(F.desc_nulls_last("lean"), "slot")))
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("lean"))).over(match)
    h = h.withColumn("turned", F.coalesce(mean(1) < mean(0), F.lit(False)))
    ranked = (F.col("n_lean") == F.col("n")) & (F.col("n") % 2 == 0)
    team = F.when(F.col("side").isNotNull(), F.when((F.col("side") == 1) != F.col("turned"), 0).otherwise(1)).when(ranked, F.when(2 * F.col("place") <= F.col("n"), 0).otherwise(1)).when(F.col("lean").isNull(), -1).when(F.col("lean") > 0, 0).otherwise(1)
    method = F.when(F.col("side").isNotNull(), "cut").when(ranked, "rank").when(F.col("n_lean") > 0, "sign").otherwise("none")
    return h.select("match_id", "slot", team.alias("team"), method.alias("method"))


@query(f"WITH {_LEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY lean DESC, slot) AS place, count(*) OVER (PARTITION BY match_id) AS n FROM leans) SELECT match_id, slot, CAST(CASE WHEN 2 * place <= n THEN 0 ELSE 1 END AS INT) AS team FROM r")
def d15_teams_by_lean(spark, data_dir):
    """The half of a match's heroes that lean most to team 0's side is team 0: the fallback of d15_teams by itself."""
    ranked = leans(spark, data_dir).withColumn("place", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("lean"), "slot"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("match_id")))
    return ranked.select("match_id", "slot", F.when(2 * F.col("place") <= F.col("n"), 0).otherwise(1).alias("team"))


@query(f"""WITH {base.ROSTER}, {base.FOG}, {base.TRANSITIONS}, {base.WARDS}
SELECT 'fog' AS src, match_id, CASE WHEN team IS NULL THEN -1 ELSE 1 - team END AS team, count(*) AS n FROM transitions GROUP BY ALL
UNION ALL SELECT 'ward', w.match_id, coalesce(r.team, -1) AS team, count(*) FROM wards w LEFT JOIN roster r ON w.match_id = r.match_id AND w.owner_slot = r.slot GROUP BY ALL""")
def d16_team_propagation(spark, data_dir):
    """Team that sees a fog transition (the hero's opponents) and team of a ward (its owner's); -1 where unknown."""
    fog = base.fog_transitions(spark, data_dir).select(F.lit("fog").alias("src"), "match_id", F.coalesce(1 - F.col("team"), F.lit(-1)).alias("team"))
    teams = base.roster(spark, data_dir).select("match_id", F.col("slot").alias("owner_slot"), F.col("team").alias("hero_team"))
    ward = base.wards(spark, data_dir).join(teams, ["match_id", "owner_slot"], "left").select(F.lit("ward").alias("src"), "match_id", F.coalesce("hero_team", F.lit(-1)).alias("team"))
    return fog.unionByName(ward).groupBy("src", "match_id", "team").agg(F.count(F.lit(1)).alias("n"))


def downs(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, t): health packets at or below LOW_HEALTH, without those less than SAME_EVENT_S after a kept one.

    Kept is relative to the last kept one, so the times of a hero (a few per match) are folded in order.
    """
    low = attribute_values(spark, data_dir, "mHP").filter(F.col("value") <= LOW_HEALTH)
    times = low.groupBy("match_id", "slot").agg(F.array_sort(F.collect_set("t")).alias("times"))
    kept = F.aggregate("times", F.array().cast("array<double>"), lambda a, t: F.when((F.size(a) == 0) | (t - F.element_at(a, -1) >= SAME_EVENT_S), F.concat(a, F.array(t))).otherwise(a))
    return times.select("match_id", "slot", F.explode(kept).alias("t"))


_DOWNS = f"""{attribute_sql('mHP')}, times AS (SELECT match_id, slot, list_sort(list(DISTINCT t)) AS ts FROM mhp WHERE value <= {LOW_HEALTH} GROUP BY match_id, slot),
folded AS (SELECT match_id, slot, list_reduce(ts, lambda a, t: CASE WHEN t[1] - a[-1] >= {SAME_EVENT_S} THEN list_append(a, t[1]) ELSE a END) AS kept FROM (SELECT match_id, slot, list_transform(ts, lambda t: [t]) AS ts FROM times)),
downs AS (SELECT match_id, slot, unnest(kept) AS t FROM folded)"""


@query(f"WITH {base.ROSTER}, {_DOWNS} SELECT match_id, slot, t FROM downs")
def d17_downs(spark, data_dir):
    """Moments at which a hero went down."""
    return downs(spark, data_dir)


@query(_ATTACKS + f""", {_DOWNS}, hits AS (SELECT d.match_id, d.slot, d.t, a.source, a.t AS ta, a.line_id, a.event_no FROM downs d JOIN attacks a ON d.match_id = a.match_id AND d.slot = a.target AND a.t BETWEEN d.t - {ATTACK_S} AND d.t + 1e-9 AND a.source <> d.slot),
k AS (SELECT match_id, slot, t, arg_max(source, struct_pack(ta := ta, l := -line_id, e := -event_no)) AS killer, count(*) AS n_attacks FROM hits GROUP BY match_id, slot, t)
SELECT k.match_id, k.slot, k.t, k.killer, any_value(k.n_attacks) AS n_attacks, round(count(h.source) / any_value(k.n_attacks), 6) AS confidence FROM k JOIN hits h ON k.match_id = h.match_id AND k.slot = h.slot AND k.t = h.t AND k.killer = h.source GROUP BY k.match_id, k.slot, k.t, k.killer""")
def d18_killers(spark, data_dir):
    """Who attacked a hero last before it went down, and that hero's share of the attacks."""
    window = downs(spark, data_dir).select("match_id", F.col("slot").alias("target"), F.col("t").alias("down_t"), (F.col("t") - ATTACK_S).alias("start"), (F.col("t") + 1e-9).alias("end"))
    hits = within_intervals(hero_attacks(spark, data_dir).filter("source <> target"), window, ["match_id", "target"], "t", "start", "end")
    per = hits.groupBy("match_id", "target", "down_t", "source").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("t", -F.col("line_id"), -F.col("event_no"))).alias("latest"))
    killer = per.groupBy("match_id", "target", "down_t").agg(F.max_by(F.struct("source", "n"), "latest").alias("k"), F.sum("n").alias("n_attacks"))
    return killer.select("match_id", F.col("target").alias("slot"), F.col("down_t").alias("t"), F.col("k.source").alias("killer"), "n_attacks", F.round(F.col("k.n") / F.col("n_attacks"), 6).alias("confidence"))


@query(f"""WITH {base.ROSTER}, {_DOWNS}, {base.ANCHORS}, p AS (SELECT *, t + 1e-9 AS u FROM downs)
SELECT p.match_id, p.slot, p.t, a.t AS back_t FROM p ASOF LEFT JOIN anchors a ON p.match_id = a.match_id AND p.slot = a.slot AND p.u <= a.t""")
def d19_back_again(spark, data_dir):
    """First anchor of a hero after it went down."""
    probes = downs(spark, data_dir).withColumn("u", F.col("t") + 1e-9)
    return as_of(probes, base.anchors(spark, data_dir), ["match_id", "slot"], "u", "t", {"t": "back_t"}, forward=True).select("match_id", "slot", "t", "back_t")


#: Greatest distance from a lane's line at which a hero is on it.
ON_LANE = 1400.0
_LANE_SHARE = f"""{base.POSITIONS}, lanes AS (SELECT match_id, slot, {lane_distance_sql('top')} AS dt, {lane_distance_sql('mid')} AS dm, {lane_distance_sql('bot')} AS db FROM positions WHERE tick >= {LANING_S[0]} AND tick < {LANING_S[1]}),
spots AS (SELECT match_id, slot, CASE WHEN least(dt, dm, db) > {ON_LANE} THEN 'jungle' WHEN dt <= dm AND dt <= db THEN 'top' WHEN dm <= db THEN 'mid' ELSE 'bot' END AS spot FROM lanes),
shares AS (SELECT match_id, slot, spot, count(*) AS n_ticks, count(*) / sum(count(*)) OVER (PARTITION BY match_id, slot) AS share FROM spots GROUP BY match_id, slot, spot)"""


def lane_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, slot, spot, n_ticks, share): where each hero spent its ticks of LANING_S; off all lanes is the jungle."""
    p = base.positions(spark, data_dir).filter((F.col("tick") >= LANING_S[0]) & (F.col("tick") < LANING_S[1]))
    far = {lane: lane_distance(F.col("x"), F.col("z"), lane) for lane in LANES}
    d = p.select("match_id", "slot", *[far[k].alias(k) for k in far])
    spot = F.when(F.least(*far) > ON_LANE, "jungle").when((F.col("top") <= F.col("mid")) & (F.col("top") <= F.col("bot")), "top").when(F.col("mid") <= F.col("bot"), "mid").otherwise("bot")
    counts = d.groupBy("match_id", "slot", spot.alias("spot")).agg(F.count(F.lit(1)).alias("n_ticks"))
    return counts.withColumn("share", F.col("n_ticks") / F.sum("n_ticks").over(Window.partitionBy("match_id", "slot")))


@query(f"WITH {_LANE_SHARE} SELECT match_id, slot, spot, n_ticks, round(share, 6) AS share FROM shares")
def d20_lane_occupancy(spark, data_dir):
    """Share of its ticks of the laning phase that each hero spent on each lane or in the jungle."""
    return lane_shares(spark, data_dir).withColumn("share", F.round("share", 6))


_WARD_SHARE = f"""{base.WARDS}, placed AS (SELECT w.match_id, r.team, w.owner_slot AS slot, count(*) AS n FROM wards w JOIN roster r ON w.match_id = r.match_id AND w.owner_slot = r.slot WHERE r.team IS NOT NULL GROUP BY ALL),
ward_shares AS (SELECT match_id, team, slot, n, n / sum(n) OVER (PARTITION BY match_id, team) AS share FROM placed)"""


def ward_shares(spark: SparkSession, data_dir: str) -> DataFrame:
    owners = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", F.col("team").alias("hero_team"))
    placed = base.wards(spark, data_dir).withColumnRenamed("owner_slot", "slot").join(owners, ["match_id", "slot"]).groupBy("match_id", F.col("hero_team").alias("team"), "slot").agg(F.count(F.lit(1)).alias("n"))
    return placed.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("match_id", "team")))


@query(f"WITH {base.ROSTER}, {_WARD_SHARE} SELECT match_id, team, slot, n AS n_wards, round(share, 6) AS share FROM ward_shares")
def d21_ward_share(spark, data_dir):
    """Each hero's share of its team's wards."""
    return ward_shares(spark, data_dir).select("match_id", "team", "slot", F.col("n").alias("n_wards"), F.round("share", 6).alias("share"))


ROLES = ["top", "jungle", "mid", "bot", "support"]
_PERMUTATIONS = ", ".join(f"({k}, {i}, '{ROLES[r]}')" for k, roles in enumerate(itertools.permutations(range(5))) for i, r in enumerate(roles))


@query(f"""WITH {base.ROSTER}, {_LANE_SHARE}, {_WARD_SHARE}, s AS (SELECT r.match_id, r.team, r.slot, coalesce(max(share) FILTER (WHERE spot = 'top'), 0) AS top, coalesce(max(share) FILTER (WHERE spot = 'jungle'), 0) AS jungle,
 coalesce(max(share) FILTER (WHERE spot = 'mid'), 0) AS mid, coalesce(max(share) FILTER (WHERE spot = 'bot'), 0) AS bot FROM roster r LEFT JOIN shares h ON r.match_id = h.match_id AND r.slot = h.slot WHERE r.team IS NOT NULL GROUP BY ALL),
five AS (SELECT s.*, coalesce(w.share, 0) AS wards, row_number() OVER (PARTITION BY s.match_id, s.team ORDER BY s.slot) - 1 AS i, count(*) OVER (PARTITION BY s.match_id, s.team) AS n FROM s LEFT JOIN ward_shares w ON s.match_id = w.match_id AND s.slot = w.slot),
p AS (SELECT * FROM (VALUES {_PERMUTATIONS}) v(k, i, role)),
t AS (SELECT f.match_id, f.team, p.k, round(sum(CASE p.role WHEN 'top' THEN top WHEN 'jungle' THEN jungle WHEN 'mid' THEN mid WHEN 'bot' THEN bot ELSE bot * 0.5 + 1.5 * wards END), 9) AS score FROM five f JOIN p ON f.i = p.i WHERE f.n = 5 GROUP BY f.match_id, f.team, p.k),
best AS (SELECT match_id, team, arg_max(k, struct_pack(score := score, k := -k)) AS k, max(score) AS score FROM t GROUP BY match_id, team)
SELECT b.match_id, b.team, f.slot, p.role, round(b.score, 6) AS score FROM best b JOIN p ON b.k = p.k JOIN five f ON f.match_id = b.match_id AND f.team = b.team AND f.i = p.i""")
def d22_roles(spark, data_dir):
    """Roles of the five heroes of each complete team: the assignment with the greatest sum of scores.

    A hero's score for a lane is its share of ticks there; for the support, its share of the bottom lane and 1.5 times its
    share of the team's wards. All 120 assignments are compared per team within one array expression.
    """
    shares = lane_shares(spark, data_dir).groupBy("match_id", "slot").pivot("spot", ["top", "jungle", "mid", "bot"]).agg(F.first("share"))
    heroes = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", "team")
    placed = ward_shares(spark, data_dir).select("match_id", "slot", F.col("share").alias("ward_share"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = heroes.join(shares, ["match_id", "slot"], "left").join(placed, ["match_id", "slot"], "left")
    scores = F.array(*[zero(c) for c in ("top", "jungle", "mid", "bot")], zero("bot") * 0.5 + 1.5 * zero("ward_share"))
    team = scored.groupBy("match_id", "team").agg(F.array_sort(F.collect_list(F.struct("slot", scores.alias("s")))).alias("five")).filter(F.size("five") == 5)
    options = []
    for k, assignment in enumerate(itertools.permutations(range(5))):
        total = sum((F.col("five")[i]["s"][r] for i, r in enumerate(assignment)), F.lit(0.0))
        options.append(F.struct(F.round(total, 9).alias("score"), F.lit(-k).alias("order"), F.array(*[F.lit(ROLES[r]) for r in assignment]).alias("roles")))
    best = team.withColumn("best", F.array_max(F.array(*options)))
    pairs = F.arrays_zip(F.transform("five", lambda h: h["slot"]).alias("slot"), F.col("best.roles").alias("role"))
    return best.select("match_id", "team", F.explode(pairs).alias("p"), F.round("best.score", 6).alias("score")).select("match_id", "team", F.col("p.slot").alias("slot"), F.col("p.role").alias("role"), "score")


@query(f"WITH {base.POSITIONS} SELECT CAST(trunc((x - {MIN_X}) / (14759.455 / 512)) AS INT) // 8 AS i, CAST(trunc((z - {MIN_Z}) / (14759.455 / 512)) AS INT) // 8 AS j, count(*) AS n_ticks, count(DISTINCT match_id) AS n_matches FROM positions GROUP BY ALL")
def e1_cells_walked(spark, data_dir):
    """Ticks per cell of a 64 x 64 grid, from cells of the 512 x 512 one."""
    cells = base.positions(spark, data_dir).select("match_id", cell(F.col("x"), MIN_X).alias("ci"), cell(F.col("z"), MIN_Z).alias("cj"))
    return cells.groupBy(F.expr("CAST(ci DIV 8 AS INT)").alias("i"), F.expr("CAST(cj DIV 8 AS INT)").alias("j")).agg(F.count(F.lit(1)).alias("n_ticks"), F.countDistinct("match_id").alias("n_matches"))


@query(f"""WITH {base.ROSTER}, {base.FOG}, {base.TRANSITIONS}, {base.TICKS}
SELECT match_id, tick, bit_or(CASE WHEN visible = 1 THEN CAST(1 AS BIGINT) << slot ELSE 0 END) AS mask, bit_count(bit_or(CASE WHEN visible = 1 THEN CAST(1 AS BIGINT) << slot ELSE 0 END))::INT AS n_visible FROM visible_ticks GROUP BY match_id, tick""")
def e4_visible_masks(spark, data_dir):
    """The visible heroes of each tick as a set of bits, and how many they are."""
    bit = F.when(F.col("visible") == 1, F.expr("shiftleft(1L, slot)")).otherwise(F.lit(0).cast("long"))
    masks = base.visible_ticks(spark, data_dir).groupBy("match_id", "tick").agg(F.bit_or(bit).alias("mask"))
    return masks.withColumn("n_visible", F.bit_count("mask"))


@query(f"WITH {base.POSITIONS}, s AS (SELECT match_id, slot, sqrt(pow(x - lag(x) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM positions WINDOW w AS (PARTITION BY match_id, slot ORDER BY tick)) SELECT match_id, slot, count(*) AS n_ticks, round(coalesce(sum(d), 0), 3) AS length, round(max(d), 3) AS longest_step FROM s GROUP BY match_id, slot")
def e11_path_lengths(spark, data_dir):
    """Length of each hero's path."""
    order = Window.partitionBy("match_id", "slot").orderBy("tick")
    step = distance(F.col("x"), F.col("z"), F.lag("x").over(order), F.lag("z").over(order))
    return base.positions(spark, data_dir).withColumn("d", step).groupBy("match_id", "slot").agg(F.count(F.lit(1)).alias("n_ticks"), F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 3).alias("length"), F.round(F.max("d"), 3).alias("longest_step"))


#: First wave, seconds between waves, speed of a wave in units a second: fixed values.
FIRST_WAVE, WAVE_EVERY, WAVE_SPEED = 65, 30, 325.0
_LENGTHS = {lane: segments(lane)[0][5] for lane in LANES}


@query(f"""WITH w AS (SELECT match_id, n_ticks, unnest(range({FIRST_WAVE}, n_ticks, {WAVE_EVERY})) AS t0 FROM matches), l AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v!r})" for k, v in _LENGTHS.items())}) v(lane, length)),
a AS (SELECT match_id, t0, lane, length, least(1.0, {WAVE_SPEED} * (n_ticks - 1 - t0) / length) AS s FROM w, l)
SELECT match_id, CAST(t0 AS INT) AS t0, lane, round(s, 6) AS reached, least(round(1 - s, 6), 1) AS reached_from_the_other_end FROM a""")
def e13_waves(spark, data_dir):
    """Waves of each match by schedule and lane, and how far along the lane each is when the match ends."""
    ticks = table(spark, data_dir, "matches", "match_id", "n_ticks").filter(F.col("n_ticks") > FIRST_WAVE)
    waves = ticks.withColumn("t0", F.explode(F.sequence(F.lit(FIRST_WAVE), F.col("n_ticks") - 1, F.lit(WAVE_EVERY))))
    lanes = F.explode(F.array(*[F.struct(F.lit(k).alias("lane"), F.lit(v).alias("length")) for k, v in _LENGTHS.items()]))
    s = F.least(F.lit(1.0), WAVE_SPEED * (F.col("n_ticks") - 1 - F.col("t0")) / F.col("l.length"))
    return waves.withColumn("l", lanes).select("match_id", "t0", F.col("l.lane").alias("lane"), F.round(s, 6).alias("reached"), F.least(F.round(1 - s, 6), F.lit(1.0)).alias("reached_from_the_other_end"))
