"""Queries over the packet log: scans (A), conformance checks (B) and normalisation (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mistrail.operators.packet_log import LEAST_TIME, repaired_times, running_clock, shard_events
from mistrail.plans import base
from mistrail.sources.tables import table

#: Half the extent of the map's frame: waypoints are centred on it.
OFFSET_X, OFFSET_Z = 7358.648, 7412.483
#: Names of replicated attributes by (primary_index, secondary_index): fixed values of the packet format.
ATTRIBUTES = {(32, 0): "mHP", (32, 1): "mMaxHP", (32, 10): "mExp", (32, 14): "mPAR", (32, 18): "mSAR", (32, 24): "mMoveSpeed", (32, 30): "mIsTargetableToTeamFlags"}

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, data_dir: str) -> DataFrame:
    return shard_events(table(spark, data_dir, "raw_shard"))


_EVENTS = """WITH lines AS (SELECT DISTINCT line_id, match_id, body FROM raw_shard WHERE json_valid(body)),
lists AS (SELECT line_id, coalesce(match_id, json_extract_string(body, '$.meta.match')) AS match_id, json_extract(body, '$.events[*]') AS list FROM lines),
ev AS (SELECT match_id, line_id, unnest(range(len(list))) AS event_no, unnest(list) AS e FROM lists),
events AS (SELECT match_id, line_id, CAST(event_no AS INT) AS event_no, json_keys(e)[1] AS kind, json_extract(e, '$.' || json_keys(e)[1]) AS payload,
  TRY_CAST(json_extract_string(e, '$.' || json_keys(e)[1] || '.time') AS DOUBLE) AS t FROM ev)"""


@query(_EVENTS + " SELECT match_id, kind, count(*) AS n_packets, min(CASE WHEN t > 1e-6 THEN t END) AS first_t, max(CASE WHEN t > 1e-6 THEN t END) AS last_t FROM events GROUP BY match_id, kind")
def a3_packets_per_kind(spark, data_dir):
    """Demultiplexed packets: number and span per match and kind."""
    good = F.when(F.col("t") > LEAST_TIME, F.col("t"))
    return events(spark, data_dir).groupBy("match_id", "kind").agg(F.count(F.lit(1)).alias("n_packets"), F.min(good).alias("first_t"), F.max(good).alias("last_t"))


@query(_EVENTS + """ SELECT match_id, line_id, event_no, kind, coalesce(max(CASE WHEN t > 1e-6 THEN t END) OVER
  (PARTITION BY match_id ORDER BY line_id, event_no ROWS UNBOUNDED PRECEDING), 0) AS clock FROM events""")
def a4_running_clock(spark, data_dir):
    """The stream's clock at each packet."""
    return running_clock(events(spark, data_dir)).select("match_id", "line_id", "event_no", "kind", "clock")


@query(_EVENTS + """ SELECT match_id, split_part(match_id, '/', 1) AS patch, count(*) AS n_packets, count(DISTINCT line_id) AS n_lines, max(CASE WHEN t > 1e-6 THEN t END) AS duration
  FROM events GROUP BY match_id""")
def a5_match_spans(spark, data_dir):
    """Per match of the shards: patch, packets, lines, duration as the last valid time."""
    good = F.when(F.col("t") > LEAST_TIME, F.col("t"))
    return events(spark, data_dir).groupBy("match_id").agg(
        F.split_part(F.first("match_id"), F.lit("/"), F.lit(1)).alias("patch"), F.count(F.lit(1)).alias("n_packets"), F.countDistinct("line_id").alias("n_lines"), F.max(good).alias("duration")
    )


@query("""WITH packets AS (SELECT DISTINCT match_id, seq, t FROM fog UNION SELECT DISTINCT match_id, seq, t FROM replication),
d AS (SELECT match_id, t - lag(t) OVER (PARTITION BY match_id ORDER BY seq) AS step FROM packets)
SELECT match_id, count(*) AS n_packets, count(*) FILTER (WHERE step < 0) AS n_inversions, count(*) FILTER (WHERE step < -0.25) AS n_errors, round(coalesce(min(step), 0), 6) AS worst FROM d GROUP BY match_id""")
def b2_time_inversions(spark, data_dir):
    """Packets whose time lies before that of the packet before them in order of arrival."""
    both = table(spark, data_dir, "fog", "match_id", "seq", "t").unionByName(table(spark, data_dir, "replication", "match_id", "seq", "t")).distinct()
    step = both.withColumn("step", F.col("t") - F.lag("t").over(Window.partitionBy("match_id").orderBy("seq")))
    return step.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n_packets"), F.count_if(F.col("step") < 0).alias("n_inversions"), F.count_if(F.col("step") < -0.25).alias("n_errors"), F.round(F.coalesce(F.min("step"), F.lit(0.0)), 6).alias("worst")
    )


def waypoints(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, line_id, event_no, t, length, point_no, x, z) in map coordinates; length is the packet's key for the list."""
    packets = events(spark, data_dir).filter(F.col("kind").isin("WaypointGroup", "WaypointGroupWithSpeed"))
    lists = packets.select("match_id", "line_id", "event_no", "t", F.explode(F.from_json(F.get_json_object("payload", "$.waypoints"), "map<string,array<struct<x:double,z:double>>>")).alias("length", "points"))
    points = lists.select("match_id", "line_id", "event_no", "t", F.expr("try_cast(length AS INT)").alias("length"), F.posexplode("points").alias("point_no", "p"))
    return points.select("match_id", "line_id", "event_no", "t", "length", "point_no", (F.col("p.x") + OFFSET_X).alias("x"), (F.col("p.z") + OFFSET_Z).alias("z"))


_WAYPOINTS = _EVENTS + f""", groups AS (SELECT *, json_extract(payload, '$.waypoints') AS w FROM events WHERE kind IN ('WaypointGroup', 'WaypointGroupWithSpeed')),
keyed AS (SELECT match_id, line_id, event_no, t, w, unnest(json_keys(w)) AS k FROM groups),
lists2 AS (SELECT match_id, line_id, event_no, t, k, CAST(json_extract(w, '$."' || k || '"') AS JSON[]) AS pts FROM keyed),
pts AS (SELECT match_id, line_id, event_no, t, TRY_CAST(k AS INT) AS length, unnest(range(len(pts))) AS point_no, unnest(pts) AS p FROM lists2),
waypoints AS (SELECT match_id, line_id, event_no, t, length, CAST(point_no AS INT) AS point_no,
  TRY_CAST(json_extract_string(p, '$.x') AS DOUBLE) + {OFFSET_X} AS x, TRY_CAST(json_extract_string(p, '$.z') AS DOUBLE) + {OFFSET_Z} AS z FROM pts)"""


@query(_WAYPOINTS + """, per AS (SELECT match_id, line_id, event_no, length, count(*) AS n FROM waypoints GROUP BY ALL)
SELECT p.match_id, count(*) AS n_orders, CAST(sum(p.n) AS BIGINT) AS n_points, count(*) FILTER (WHERE p.n <> p.length) AS n_wrong_length,
 any_value(q.outside) AS n_outside FROM per p JOIN (SELECT match_id, count(*) FILTER (WHERE NOT (x BETWEEN -2000 AND 16760 AND z BETWEEN -2000 AND 16760)) AS outside FROM waypoints GROUP BY match_id) q
 ON p.match_id = q.match_id GROUP BY p.match_id""")
def b3_waypoint_bounds(spark, data_dir):
    """Orders per match: points, lists that aren't as long as their key says, points far off the map."""
    off = ~(F.col("x").between(-2000, 16760) & F.col("z").between(-2000, 16760))
    per = waypoints(spark, data_dir).groupBy("match_id", "line_id", "event_no", "length").agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off"))
    return per.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("n").alias("n_points"), F.count_if(F.col("n") != F.col("length")).alias("n_wrong_length"), F.sum("off").alias("n_outside"))


@query("""WITH u AS (SELECT match_id, net_id, count(DISTINCT hero_name) AS names, count(DISTINCT champion) AS champions, count(DISTINCT slot) AS slots FROM hero GROUP BY match_id, net_id)
SELECT match_id, count(*) AS n_heroes, count(*) FILTER (WHERE names > 1 OR champions > 1 OR slots > 1) AS n_changing, count(*) = 10 AS complete FROM u GROUP BY match_id""")
def b4_hero_identity(spark, data_dir):
    """Heroes per match, and those whose keyframes disagree about who they are."""
    one = table(spark, data_dir, "hero").groupBy("match_id", "net_id").agg(*[F.countDistinct(c).alias(c) for c in ("hero_name", "champion", "slot")])
    return one.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_heroes"), F.count_if((F.col("hero_name") > 1) | (F.col("champion") > 1) | (F.col("slot") > 1)).alias("n_changing"), (F.count(F.lit(1)) == 10).alias("complete"))


@query("""WITH used AS (SELECT 'fog' AS src, match_id, net_id FROM fog UNION SELECT 'replication', match_id, net_id FROM replication UNION SELECT 'anchor', match_id, target FROM anchor WHERE target > 0),
known AS (SELECT match_id, net_id FROM hero UNION SELECT match_id, net_id FROM ward_event)
SELECT src, u.match_id, count(*) AS n_units, count(*) FILTER (WHERE k.net_id IS NULL) AS n_dangling FROM used u LEFT JOIN known k ON u.match_id = k.match_id AND u.net_id = k.net_id GROUP BY src, u.match_id""")
def b5_dangling_units(spark, data_dir):
    """Units that packets refer to without a packet that creates them."""
    pick = lambda name, column: table(spark, data_dir, name).select(F.lit(name).alias("src"), "match_id", F.col(column).alias("net_id"))
    used = pick("fog", "net_id").unionByName(pick("replication", "net_id")).unionByName(pick("anchor", "target").filter("net_id > 0")).distinct()
    known = table(spark, data_dir, "hero", "match_id", "net_id").unionByName(table(spark, data_dir, "ward_event", "match_id", "net_id")).distinct().withColumn("known", F.lit(True))
    return used.join(known, ["match_id", "net_id"], "left").groupBy("src", "match_id").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("known").isNull()).alias("n_dangling"))


@query(f"WITH {base.ROSTER}, {base.FOG} , d AS (SELECT match_id, visible = lag(visible) OVER (PARTITION BY match_id, slot ORDER BY t, seq) AS again FROM packets) SELECT match_id, count(*) AS n_packets, count(*) FILTER (WHERE again) AS n_repeats FROM d GROUP BY match_id")
def b6_fog_alternation(spark, data_dir):
    """Fog packets that repeat the state of the one before."""
    order = Window.partitionBy("match_id", "slot").orderBy("t", "seq")
    return base.fog_packets(spark, data_dir).withColumn("again", F.col("visible") == F.lag("visible").over(order)).groupBy("match_id").agg(F.count(F.lit(1)).alias("n_packets"), F.count_if("again").alias("n_repeats"))


@query("""WITH p AS (SELECT 'anchor' AS src, match_id, x, z FROM anchor UNION ALL SELECT 'attribution', match_id, x, z FROM attribution UNION ALL SELECT 'ward_event', match_id, x, z FROM ward_event)
SELECT src, match_id, count(*) AS n_rows, count(*) FILTER (WHERE x IS NULL OR z IS NULL OR isnan(x) OR isnan(z)) AS n_missing,
count(*) FILTER (WHERE NOT isnan(x) AND NOT isnan(z) AND (x < -2000 OR x > 16760 OR z < -2000 OR z > 16760)) AS n_outside FROM p GROUP BY src, match_id""")
def b7_positions_outside(spark, data_dir):
    """Positions that are missing or far off the map, per table and match."""
    rows = None
    for name in ("anchor", "attribution", "ward_event"):
        part = table(spark, data_dir, name, "match_id", "x", "z").withColumn("src", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    gone = F.col("x").isNull() | F.col("z").isNull() | F.isnan("x") | F.isnan("z")
    off = ~F.isnan("x") & ~F.isnan("z") & ((F.col("x") < -2000) | (F.col("x") > 16760) | (F.col("z") < -2000) | (F.col("z") > 16760))
    return rows.groupBy("src", "match_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(gone).alias("n_missing"), F.count_if(off).alias("n_outside"))


@query(f"""WITH {base.ANCHORS}, {base.WARDS}, o AS (SELECT match_id, count(DISTINCT order_no) AS n_orders FROM move_order GROUP BY match_id),
a AS (SELECT match_id, count(*) AS n_anchors, count(DISTINCT slot) AS n_slots FROM anchors GROUP BY match_id), w AS (SELECT match_id, count(*) AS n_wards FROM wards GROUP BY match_id)
SELECT m.match_id, coalesce(n_orders, 0) AS n_orders, coalesce(n_anchors, 0) AS n_anchors, round(n_anchors / n_slots, 4) AS anchors_per_hero, coalesce(n_wards, 0) AS n_wards
FROM matches m LEFT JOIN o USING (match_id) LEFT JOIN a USING (match_id) LEFT JOIN w USING (match_id)""")
def b9_match_summary(spark, data_dir):
    """Orders, anchors per hero and wards of each match."""
    orders = table(spark, data_dir, "move_order", "match_id", "order_no").groupBy("match_id").agg(F.countDistinct("order_no").alias("n_orders"))
    anchors = base.anchors(spark, data_dir).groupBy("match_id").agg(F.count(F.lit(1)).alias("n_anchors"), F.countDistinct("slot").alias("n_slots"))
    wards = base.wards(spark, data_dir).groupBy("match_id").agg(F.count(F.lit(1)).alias("n_wards"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = table(spark, data_dir, "matches", "match_id").join(orders, "match_id", "left").join(anchors, "match_id", "left").join(wards, "match_id", "left")
    return joined.select("match_id", zero("n_orders"), zero("n_anchors"), F.round(F.col("n_anchors") / F.col("n_slots"), 4).alias("anchors_per_hero"), zero("n_wards"))


@query("""WITH f AS (SELECT * FROM hero QUALIFY row_number() OVER (PARTITION BY match_id, net_id ORDER BY t, slot) = 1)
SELECT match_id, CAST(dense_rank() OVER (PARTITION BY match_id ORDER BY net_id) - 1 AS INT) AS dense_slot, net_id, hero_name, champion, team FROM f""")
def c1_hero_roster(spark, data_dir):
    """One row per hero: its first keyframe, with a dense slot by net_id."""
    first = Window.partitionBy("match_id", "net_id").orderBy("t", "slot")
    rows = table(spark, data_dir, "hero").withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    return rows.select("match_id", (F.dense_rank().over(Window.partitionBy("match_id").orderBy("net_id")) - 1).alias("dense_slot"), "net_id", "hero_name", "champion", "team")


@query(_WAYPOINTS + f""", {base.POSITIONS}, walkable AS (SELECT DISTINCT CAST(floor(x / 115.3125) AS INT) AS i, CAST(floor(z / 115.3125) AS INT) AS j FROM positions),
tries AS (SELECT match_id, x, z, unnest(range(-200, 201, 50)) AS dx FROM waypoints)
SELECT match_id, CAST(dx AS INT) AS dx, count(*) AS n_points, round(avg(CASE WHEN w.i IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate
FROM tries LEFT JOIN walkable w ON w.i = CAST(floor((x + dx) / 115.3125) AS INT) AND w.j = CAST(floor(z / 115.3125) AS INT) GROUP BY match_id, dx""")
def c2_frame_fit(spark, data_dir):
    """How many waypoints lie on walked ground for each trial offset of the frame in x.

    Walked ground are the cells of a 128 x 128 grid in which the trajectories lie.
    """
    cell = 14_760.0 / 128
    walkable = base.positions(spark, data_dir).select(F.floor(F.col("x") / cell).cast("int").alias("i"), F.floor(F.col("z") / cell).cast("int").alias("j")).distinct().withColumn("hit", F.lit(1.0))
    tries = waypoints(spark, data_dir).select("match_id", "x", "z", F.explode(F.sequence(F.lit(-200), F.lit(200), F.lit(50))).alias("dx"))
    cells = tries.withColumn("i", F.floor((F.col("x") + F.col("dx")) / cell).cast("int")).withColumn("j", F.floor(F.col("z") / cell).cast("int"))
    return cells.join(walkable, ["i", "j"], "left").groupBy("match_id", "dx").agg(F.count(F.lit(1)).alias("n_points"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("hit_rate"))


@query(_WAYPOINTS + " SELECT match_id, line_id, event_no, point_no, round(x, 3) AS x, round(z, 3) AS z FROM waypoints")
def c3_waypoints_on_map(spark, data_dir):
    """Waypoints moved from the centred frame to the map's."""
    return waypoints(spark, data_dir).select("match_id", "line_id", "event_no", "point_no", F.round("x", 3).alias("x"), F.round("z", 3).alias("z"))


@query(_EVENTS + """, r AS (SELECT *, row_number() OVER w AS rank, CASE WHEN t > 1e-6 THEN t END AS good FROM events WINDOW w AS (PARTITION BY match_id ORDER BY line_id, event_no)),
g AS (SELECT *, CASE WHEN good IS NOT NULL THEN rank END AS gr FROM r),
n AS (SELECT *, last_value(good IGNORE NULLS) OVER b AS t0, last_value(gr IGNORE NULLS) OVER b AS r0, first_value(good IGNORE NULLS) OVER a AS t1, first_value(gr IGNORE NULLS) OVER a AS r1 FROM g
  WINDOW b AS (PARTITION BY match_id ORDER BY rank ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY match_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT match_id, line_id, event_no, kind, good IS NOT NULL AS t_own, round(CASE WHEN good IS NOT NULL THEN good WHEN r0 IS NULL THEN t1 WHEN r1 IS NULL THEN t0 ELSE t0 + (t1 - t0) * (rank - r0) / (r1 - r0) END, 6) AS t_repaired
FROM n WHERE kind = 'SpawnMinion'""")
def c5_spawn_times(spark, data_dir):
    """Times of spawn packets, whose own are mostly garbage, from the stream around them."""
    return repaired_times(events(spark, data_dir)).filter("kind = 'SpawnMinion'").select("match_id", "line_id", "event_no", "kind", "t_own", F.round("t_repaired", 6).alias("t_repaired"))


@query(f"WITH {base.ROSTER}, {base.FOG}, {base.TRANSITIONS} SELECT match_id, slot, team, t, seq, visible FROM transitions")
def c6_fog_timeline(spark, data_dir):
    """Alternating transitions of each hero between hidden and visible."""
    return base.fog_transitions(spark, data_dir)


@query(f"WITH {base.WARDS} SELECT match_id, net_id, owner_slot, team, kind, t0, CASE WHEN isinf(t1) THEN NULL ELSE round(t1, 6) END AS t1, isinf(t1) AS stays, sight FROM wards")
def c8_ward_lifetimes(spark, data_dir):
    """Wards with their lifetime, modelled by kind where its end is missing."""
    endless = F.col("t1") == float("inf")
    return base.wards(spark, data_dir).select("match_id", "net_id", "owner_slot", "team", "kind", "t0", F.when(~endless, F.round("t1", 6)).alias("t1"), endless.alias("stays"), "sight")


def hero_attacks(spark: SparkSession, data_dir: str) -> DataFrame:
    """(match_id, t, source, target) of attacks between heroes, by slot."""
    packets = events(spark, data_dir).filter("kind = 'BasicAttackPos'")
    number = lambda path: F.expr(f"try_cast(get_json_object(payload, '$.{path}') AS BIGINT)")
    several = F.from_json(F.get_json_object("payload", "$.target_net_ids"), "array<bigint>")
    rows = packets.select("match_id", "line_id", "event_no", "t", F.coalesce(number("source_net_id"), number("caster_net_id")).alias("source_net_id"), F.explode(F.coalesce(several, F.array(number("target_net_id")))).alias("target_net_id"))
    hero = base.roster(spark, data_dir)
    source = hero.select("match_id", F.col("net_id").alias("source_net_id"), F.col("slot").alias("source"))
    target = hero.select("match_id", F.col("net_id").alias("target_net_id"), F.col("slot").alias("target"))
    return rows.join(source, ["match_id", "source_net_id"]).join(target, ["match_id", "target_net_id"]).select("match_id", "line_id", "event_no", "t", "source", "target")


_ATTACKS = _EVENTS + f""", {base.ROSTER}, raw AS (SELECT match_id, line_id, event_no, t,
  coalesce(TRY_CAST(json_extract_string(payload, '$.source_net_id') AS BIGINT), TRY_CAST(json_extract_string(payload, '$.caster_net_id') AS BIGINT)) AS s,
  unnest(coalesce(TRY_CAST(json_extract(payload, '$.target_net_ids') AS BIGINT[]), [TRY_CAST(json_extract_string(payload, '$.target_net_id') AS BIGINT)])) AS g FROM events WHERE kind = 'BasicAttackPos'),
attacks AS (SELECT raw.match_id, line_id, event_no, raw.t, a.slot AS source, b.slot AS target FROM raw JOIN roster a ON a.match_id = raw.match_id AND a.net_id = s JOIN roster b ON b.match_id = raw.match_id AND b.net_id = g)"""


@query(_ATTACKS + " SELECT match_id, source, target, count(*) AS n_attacks, min(t) AS first_t, max(t) AS last_t FROM attacks GROUP BY match_id, source, target")
def c9_hero_attacks(spark, data_dir):
    """Attacks between heroes, per pair."""
    return hero_attacks(spark, data_dir).groupBy("match_id", "source", "target").agg(F.count(F.lit(1)).alias("n_attacks"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(_EVENTS + f""", {base.ROSTER}, act AS (SELECT match_id, line_id, event_no, t, CASE WHEN kind = 'CastSpellAns' THEN 0 ELSE 1 END AS anchor_kind,
  coalesce(TRY_CAST(json_extract_string(payload, '$.source_net_id') AS BIGINT), TRY_CAST(json_extract_string(payload, '$.caster_net_id') AS BIGINT)) AS s,
  TRY_CAST(json_extract_string(payload, '$.source_position.x') AS DOUBLE) AS x, TRY_CAST(json_extract_string(payload, '$.source_position.z') AS DOUBLE) AS z
  FROM events WHERE kind IN ('CastSpellAns', 'BasicAttackPos'))
SELECT a.match_id, a.line_id, a.event_no, r.slot, a.t, a.anchor_kind, a.x, a.z FROM act a JOIN roster r ON a.match_id = r.match_id AND a.s = r.net_id WHERE x IS NOT NULL AND z IS NOT NULL""")
def c13_anchors_from_packets(spark, data_dir):
    """Labelled positions: casts and attacks of heroes that give where they were."""
    packets = events(spark, data_dir).filter(F.col("kind").isin("CastSpellAns", "BasicAttackPos"))
    get = lambda path, kind: F.expr(f"try_cast(get_json_object(payload, '$.{path}') AS {kind})")
    rows = packets.select(
        "match_id", "line_id", "event_no", "t", F.when(F.col("kind") == "CastSpellAns", 0).otherwise(1).alias("anchor_kind"), F.coalesce(get("source_net_id", "BIGINT"), get("caster_net_id", "BIGINT")).alias("net_id"),
        get("source_position.x", "DOUBLE").alias("x"), get("source_position.z", "DOUBLE").alias("z"),
    ).filter("x IS NOT NULL AND z IS NOT NULL")
    return rows.join(base.roster(spark, data_dir), ["match_id", "net_id"]).select("match_id", "line_id", "event_no", "slot", "t", "anchor_kind", "x", "z")


def attribute_values(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """(match_id, slot, t, seq, value) of one replicated attribute of the heroes, by name or, where that is missing, by index."""
    index = next(k for k, v in ATTRIBUTES.items() if v == name)
    rows = table(spark, data_dir, "replication").filter(
        (F.lower("attr_name") == name.lower()) | ((F.coalesce("attr_name", F.lit("")) == "") & (F.col("primary_index") == index[0]) & (F.col("secondary_index") == index[1]))
    ).filter("repl_value IS NOT NULL AND NOT isnan(repl_value)")
    return rows.select("match_id", "net_id", "t", "seq", "repl_value").distinct().join(base.roster(spark, data_dir), ["match_id", "net_id"]).select("match_id", "slot", "t", "seq", F.col("repl_value").alias("value"))


def attribute_sql(name: str) -> str:
    index = next(k for k, v in ATTRIBUTES.items() if v == name)
    return f"""{name.lower()} AS (SELECT DISTINCT p.match_id, r.slot, p.t, p.seq, p.repl_value AS value FROM replication p JOIN roster r ON p.match_id = r.match_id AND p.net_id = r.net_id
  WHERE (lower(attr_name) = '{name.lower()}' OR (coalesce(attr_name, '') = '' AND primary_index = {index[0]} AND secondary_index = {index[1]})) AND repl_value IS NOT NULL AND NOT isnan(repl_value))"""


@query(f"WITH {base.ROSTER}, {attribute_sql('mMoveSpeed')} SELECT match_id, slot, count(*) AS n_values, round(min(value), 4) AS slowest, round(max(value), 4) AS fastest, round(arg_max(value, struct_pack(t := t, seq := seq)), 4) AS last_value FROM mmovespeed GROUP BY match_id, slot")
def c14_move_speeds(spark, data_dir):
    """Replicated movement speed of each hero."""
    return attribute_values(spark, data_dir, "mMoveSpeed").groupBy("match_id", "slot").agg(
        F.count(F.lit(1)).alias("n_values"), F.round(F.min("value"), 4).alias("slowest"), F.round(F.max("value"), 4).alias("fastest"), F.round(F.max_by("value", F.struct("t", "seq")), 4).alias("last_value")
    )


@query("WITH o AS (SELECT DISTINCT * FROM move_order) SELECT match_id, order_no, CAST(row_number() OVER (PARTITION BY match_id ORDER BY t, order_no) - 1 AS INT) AS place, owner, t FROM o")
def c15_order_sequence(spark, data_dir):
    """Orders of each match in order of time."""
    rows = table(spark, data_dir, "move_order").distinct()
    return rows.select("match_id", "order_no", (F.row_number().over(Window.partitionBy("match_id").orderBy("t", "order_no")) - 1).alias("place"), "owner", "t")


@query(f"""WITH {base.ROSTER}, {base.FOG}, {base.TRANSITIONS}, i AS (SELECT match_id, count(*) AS rows_in FROM fog GROUP BY match_id), o AS (SELECT match_id, count(*) AS rows_out FROM transitions GROUP BY match_id)
SELECT i.match_id, rows_in, coalesce(rows_out, 0) AS rows_out, round(coalesce(rows_out, 0) / rows_in, 6) AS kept FROM i LEFT JOIN o ON i.match_id = o.match_id""")
def c16_fog_reduction(spark, data_dir):
    """Fog rows before and after they are brought to transitions."""
    before = table(spark, data_dir, "fog", "match_id").groupBy("match_id").agg(F.count(F.lit(1)).alias("rows_in"))
    after = base.fog_transitions(spark, data_dir).groupBy("match_id").agg(F.count(F.lit(1)).alias("rows_out"))
    out = F.coalesce("rows_out", F.lit(0))
    return before.join(after, "match_id", "left").select("match_id", "rows_in", out.alias("rows_out"), F.round(out / F.col("rows_in"), 6).alias("kept"))


#: Fields of the packets by kind: name, place in the payload (the first that is given counts), type, and what stands where
#: it isn't given. Null stands for an unknown position.
PACKETS = {
    "casts": ("CastSpellAns", [("caster_net_id", ["caster_net_id"], "BIGINT", 0), ("spell_name", ["spell_name"], "STRING", ""), ("slot", ["slot"], "INT", -1), ("src_x", ["source_position.x"], "DOUBLE", None), ("src_z", ["source_position.z"], "DOUBLE", None), ("tgt_x", ["target_position.x"], "DOUBLE", None), ("tgt_z", ["target_position.z"], "DOUBLE", None)]),
    "attacks": ("BasicAttackPos", [("source_net_id", ["source_net_id", "caster_net_id"], "BIGINT", 0), ("target_net_id", ["target_net_id"], "BIGINT", 0), ("src_x", ["source_position.x"], "DOUBLE", None), ("src_z", ["source_position.z"], "DOUBLE", None), ("tgt_x", ["target_position.x"], "DOUBLE", None), ("tgt_z", ["target_position.z"], "DOUBLE", None)]),
    "neutrals": ("CreateNeutral", [("net_id", ["net_id"], "BIGINT", 0), ("name", ["name"], "STRING", ""), ("camp_id", ["camp_id"], "INT", 0), ("neutral_type", ["neutral_type"], "INT", 0), ("x", ["position1.x"], "DOUBLE", None), ("z", ["position1.z"], "DOUBLE", None)]),
    "minions": ("SpawnMinion", [("net_id", ["net_id"], "BIGINT", 0), ("name", ["name"], "STRING", ""), ("skin_name", ["skin_name"], "STRING", ""), ("targetable_on_client", ["targetable_on_client"], "BIGINT", 0), ("x", ["position1.x"], "DOUBLE", None), ("z", ["position1.z"], "DOUBLE", None)]),
}


def typed_packets(spark: SparkSession, data_dir: str, table_name: str) -> DataFrame:
    """(match_id, line_id, event_no, t, the fields of PACKETS[table_name]): the packets of one kind as a flat table."""
    kind, fields = PACKETS[table_name]
    got = lambda path, to: F.expr(f"try_cast(get_json_object(payload, '$.{path}') AS {to})")
    columns = [F.coalesce(*[got(p, to) for p in paths], F.lit(default).cast(to)).alias(name) for name, paths, to, default in fields]
    return events(spark, data_dir).filter(F.col("kind") == kind).select("match_id", "line_id", "event_no", "t", *columns)


def _typed_sql(table_name: str) -> str:
    kind, fields = PACKETS[table_name]
    sql = {"STRING": "VARCHAR", "INT": "INT", "BIGINT": "BIGINT", "DOUBLE": "DOUBLE"}
    text = lambda default: "NULL" if default is None else repr(default)
    columns = [f"coalesce({', '.join(f'''TRY_CAST(json_extract_string(payload, '$.{p}') AS {sql[to]})''' for p in paths)}, CAST({text(default)} AS {sql[to]})) AS {name}" for name, paths, to, default in fields]
    return _EVENTS + f" SELECT match_id, line_id, event_no, t, {', '.join(columns)} FROM events WHERE kind = '{kind}'"


@query(_typed_sql("casts"))
def a3_casts(spark, data_dir):
    """Spell casts as a flat table."""
    return typed_packets(spark, data_dir, "casts")


@query(_typed_sql("attacks"))
def a3_attacks(spark, data_dir):
    """Basic attacks as a flat table."""
    return typed_packets(spark, data_dir, "attacks")


@query(_typed_sql("neutrals"))
def a3_neutrals(spark, data_dir):
    """Created neutral units as a flat table."""
    return typed_packets(spark, data_dir, "neutrals")


@query(_typed_sql("minions"))
def a3_minions(spark, data_dir):
    """Spawned units as a flat table."""
    return typed_packets(spark, data_dir, "minions")


@query(_EVENTS + f""", {base.ANCHORS}, f AS (SELECT match_id, count(*) AS n_fog, count(*) FILTER (WHERE leaving) AS n_leaving, count(DISTINCT net_id) AS n_units FROM fog GROUP BY match_id),
r AS (SELECT match_id, count(*) AS n_replication FROM replication GROUP BY match_id), a AS (SELECT match_id, count(*) AS n_anchors, count(DISTINCT slot) AS n_anchored FROM anchors GROUP BY match_id),
e AS (SELECT match_id, count(*) AS n_packets, count(DISTINCT kind) AS n_kinds FROM events GROUP BY match_id)
SELECT m.match_id, coalesce(n_fog, 0) AS n_fog, coalesce(n_leaving, 0) AS n_leaving, coalesce(n_units, 0) AS n_units, coalesce(n_replication, 0) AS n_replication, coalesce(n_anchors, 0) AS n_anchors, coalesce(n_anchored, 0) AS n_anchored, coalesce(e.n_packets, 0) AS n_packets, coalesce(n_kinds, 0) AS n_kinds
FROM matches m LEFT JOIN f ON m.match_id = f.match_id LEFT JOIN r ON m.match_id = r.match_id LEFT JOIN a ON m.match_id = a.match_id LEFT JOIN e ON m.match_id = e.match_id""")
def a6_reconnaissance(spark, data_dir):
    """What there is of each match: fog and replication packets, anchors, packets of the shards."""
    fog = table(spark, data_dir, "fog", "match_id", "leaving", "net_id").groupBy("match_id").agg(F.count(F.lit(1)).alias("n_fog"), F.count_if("leaving").alias("n_leaving"), F.countDistinct("net_id").alias("n_units"))
    replication = table(spark, data_dir, "replication", "match_id").groupBy("match_id").agg(F.count(F.lit(1)).alias("n_replication"))
    anchors = base.anchors(spark, data_dir).groupBy("match_id").agg(F.count(F.lit(1)).alias("n_anchors"), F.countDistinct("slot").alias("n_anchored"))
    shards = events(spark, data_dir).groupBy("match_id").agg(F.count(F.lit(1)).alias("n_packets"), F.countDistinct("kind").alias("n_kinds"))
    joined = table(spark, data_dir, "matches", "match_id")
    for part in (fog, replication, anchors, shards):
        joined = joined.join(part, "match_id", "left")
    return joined.na.fill(0)


@query(_EVENTS + """, r AS (SELECT match_id, kind, count(*) AS n_packets, count(*) FILTER (WHERE t IS NULL OR t <= 1e-6) AS n_repaired FROM events GROUP BY match_id, kind)
SELECT match_id, kind, n_packets, n_repaired, round(n_repaired / n_packets, 6) AS share FROM r""")
def c16_repaired_times(spark, data_dir):
    """Packets of each kind whose time had to be found from the stream around them."""
    counts = repaired_times(events(spark, data_dir)).groupBy("match_id", "kind").agg(F.count(F.lit(1)).alias("n_packets"), F.count_if(~F.col("t_own")).alias("n_repaired"))
    return counts.withColumn("share", F.round(F.col("n_repaired") / F.col("n_packets"), 6))


#: Trial offsets of the frame: how far, how fine, and by how much less than the best a hit rate may be on the plateau.
OFFSET_MOST, OFFSET_STEP, PLATEAU = 200.0, 0.5, 0.005
_CALIBRATION = f"""{base.POSITIONS}, walkable AS (SELECT DISTINCT CAST(floor(x / 115.3125) AS INT) AS i, CAST(floor(z / 115.3125) AS INT) AS j FROM positions), points AS (SELECT match_id, x, z FROM waypoints WHERE x IS NOT NULL AND z IS NOT NULL),
xs AS (SELECT match_id, d * {OFFSET_STEP} AS dx, round(avg(CASE WHEN w.i IS NULL THEN 0.0 ELSE 1.0 END), 9) AS rate, count(*) AS n FROM (SELECT *, unnest(range(-400, 401)) AS d FROM points) p LEFT JOIN walkable w ON w.i = CAST(floor((x + d * {OFFSET_STEP}) / 115.3125) AS INT) AND w.j = CAST(floor(z / 115.3125) AS INT) GROUP BY match_id, d),
bx AS (SELECT match_id, arg_max(dx, struct_pack(r := rate, o := -dx)) AS dx, max(rate) AS top, min(rate) AS least, any_value(n) AS n FROM xs GROUP BY match_id),
flat AS (SELECT x.match_id, count(*) * {OFFSET_STEP} AS plateau FROM xs x JOIN bx b ON x.match_id = b.match_id WHERE x.rate >= b.top - {PLATEAU} GROUP BY x.match_id),
zs AS (SELECT p.match_id, d * {OFFSET_STEP} AS dz, round(avg(CASE WHEN w.i IS NULL THEN 0.0 ELSE 1.0 END), 9) AS rate FROM (SELECT q.*, b.dx, unnest(range(-400, 401)) AS d FROM points q JOIN bx b ON q.match_id = b.match_id) p LEFT JOIN walkable w ON w.i = CAST(floor((x + dx) / 115.3125) AS INT) AND w.j = CAST(floor((z + d * {OFFSET_STEP}) / 115.3125) AS INT) GROUP BY p.match_id, d),
bz AS (SELECT match_id, arg_max(dz, struct_pack(r := rate, o := -dz)) AS dz, max(rate) AS top FROM zs GROUP BY match_id)"""


@query(_WAYPOINTS + ", " + _CALIBRATION + " SELECT bx.match_id, bx.n AS n_points, bx.dx, bz.dz, round(bz.top, 6) AS hit_rate, round(bx.least, 6) AS least_rate, flat.plateau FROM bx JOIN flat ON bx.match_id = flat.match_id JOIN bz ON bx.match_id = bz.match_id")
def c2_frame_calibration(spark, data_dir):
    """The offset of the frame with most waypoints on walked ground: first in x, then in z at the best x, the first of equals;
    and how wide the plateau around it is.

    Points are spread over the trial offsets, hits looked up by equality and averaged with partial sums on the map side.
    """
    cell = 14_760.0 / 128
    walkable = base.positions(spark, data_dir).select(F.floor(F.col("x") / cell).cast("int").alias("i"), F.floor(F.col("z") / cell).cast("int").alias("j")).distinct().withColumn("hit", F.lit(1.0))
    points = waypoints(spark, data_dir).filter("x IS NOT NULL AND z IS NOT NULL").select("match_id", "x", "z")
    steps = round(OFFSET_MOST / OFFSET_STEP)

    def rates(rows: DataFrame, dx, dz) -> DataFrame:
        tried = rows.withColumn("o", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).withColumn("o", F.col("o") * OFFSET_STEP)
        at = lambda v: F.floor(v / cell).cast("int")
        cells = tried.select("match_id", "o", at(F.col("x") + dx).alias("i"), at(F.col("z") + dz).alias("j"))
        return cells.join(walkable, ["i", "j"], "left").groupBy("match_id", "o").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 9).alias("rate"), F.count(F.lit(1)).alias("n"))

    best = F.max_by("o", F.struct("rate", -F.col("o")))
    xs = rates(points, F.col("o"), F.lit(0.0))
    bx = xs.groupBy("match_id").agg(best.alias("dx"), F.max("rate").alias("top"), F.min("rate").alias("least"), F.max("n").alias("n_points"))
    flat = xs.join(bx, "match_id").filter(F.col("rate") >= F.col("top") - PLATEAU).groupBy("match_id").agg((F.count(F.lit(1)) * OFFSET_STEP).alias("plateau"))
    bz = rates(points.join(bx.select("match_id", "dx"), "match_id").withColumn("x", F.col("x") + F.col("dx")), F.lit(0.0), F.col("o")).groupBy("match_id").agg(best.alias("dz"), F.max("rate").alias("ztop"))
    return bx.join(flat, "match_id").join(bz, "match_id").select("match_id", "n_points", "dx", "dz", F.round("ztop", 6).alias("hit_rate"), F.round("least", 6).alias("least_rate"), "plateau")
