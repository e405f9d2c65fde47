"""Buildings and lane units from their packets: sites, labels by votes, lifetimes, contacts, and what they light up.

The given tables hold no such packets; the operators take tables of the shapes named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mistrail.functions.geometry import LANES, lane_distance, segments
from mistrail.operators.labels import majority_label

#: Parts of a turret's name that tell its team (0, 1), the plainer ones first: fixed values.
TEAM_TOKENS = {"T1": 0, "T2": 1}
SHRINE_TOKENS = {"OrderTurretShrine": 0, "ChaosTurretShrine": 1}
#: Sight of turrets and lane units, units a second of a wave, seconds that one lives if its end isn't seen, and how near to
#: a lane a turret stands whose lane counts.
TURRET_SIGHT, UNIT_SIGHT, WAVE_SPEED, UNIT_LIFE_S, ON_LANE = 1_350.0, 1_200.0, 325.0, 55.0, 1_500.0
LEAST_VOTES = 5


def team_of_name(name: Column) -> Column:
    """Team by the tokens of a turret's name, null where it has none."""
    found = F.lit(None).cast("int")
    for token, team in reversed([*TEAM_TOKENS.items(), *SHRINE_TOKENS.items()]):
        found = F.when(F.contains(name, F.lit(token)), team).otherwise(found)
    return found


def turret_report(turrets: DataFrame) -> DataFrame:
    """(match_id, n_turrets, n_without_team): turrets per match, and those whose name tells no team."""
    one = turrets.groupBy("match_id", "net_id").agg(F.max("name").alias("name"))
    return one.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_turrets"), F.count_if(team_of_name(F.col("name")).isNull()).alias("n_without_team"))


def turret_sites(turrets: DataFrame, attacks: DataFrame, deaths: DataFrame, known: DataFrame) -> DataFrame:
    """(match_id, net_id, name, team, x, z, n_attacks, destroyed_t), one row per turret.

    ``turrets``: match_id, net_id, name, seq (the last name counts). ``attacks``: match_id, source_net_id, x, z.
    ``deaths``: match_id, killed_net_id, t, seq (the first counts). ``known``: name, team, x, z, the sites that are known by
    name. A site that isn't lies at the median of its attacks, or nowhere (null). destroyed_t is infinite for a turret that
    stands to the end.
    """
    one = turrets.filter("match_id IS NOT NULL AND net_id IS NOT NULL").groupBy("match_id", "net_id").agg(F.max_by("name", "seq").alias("name"))
    fired = attacks.groupBy("match_id", F.col("source_net_id").alias("net_id")).agg(F.count(F.lit(1)).alias("n_attacks"), F.percentile("x", F.lit(0.5)).alias("ax"), F.percentile("z", F.lit(0.5)).alias("az"))
    fell = deaths.groupBy("match_id", F.col("killed_net_id").alias("net_id")).agg(F.min_by("t", "seq").alias("destroyed_t"))
    sites = known.select("name", F.col("team").alias("kteam"), F.col("x").alias("kx"), F.col("z").alias("kz"))
    joined = one.join(F.broadcast(sites) if known.limit(1001).count() <= 1000 else sites, "name", "left").join(fired, ["match_id", "net_id"], "left").join(fell, ["match_id", "net_id"], "left")
    return joined.select(
        "match_id", "net_id", "name", F.coalesce(team_of_name(F.col("name")), "kteam").alias("team"), F.coalesce("kx", "ax").alias("x"), F.coalesce("kz", "az").alias("z"),
        F.coalesce("n_attacks", F.lit(0)).alias("n_attacks"), F.coalesce("destroyed_t", F.lit(float("inf"))).alias("destroyed_t"),
    )


def _lane_of(x: Column, z: Column) -> Column:
    """The nearest lane and how far it is."""
    return F.array_min(F.array(*[F.struct(lane_distance(x, z, lane).alias("d"), F.lit(k).alias("k"), F.lit(lane).alias("lane")) for k, lane in enumerate(LANES)]))


def barrack_labels(barracks: DataFrame, damage: DataFrame, sites: DataFrame) -> DataFrame:
    """(match_id, barrack_net_id, lane, team, votes): what each barrack spawns for, by who fights its units.

    ``barracks``: match_id, minion_net_id, barrack_net_id. ``damage``: match_id, t, seq, source_net_id, target_net_id.
    ``sites``: those of ``turret_sites``. Each exchange between a unit and a turret on a lane is a vote for the turret's lane
    and for the team that isn't the turret's; the label with most votes counts (of equal ones the first seen), from
    LEAST_VOTES on.
    """
    units = barracks.groupBy("match_id", F.col("minion_net_id").alias("unit")).agg(F.max("barrack_net_id").alias("barrack_net_id"))
    on_lane = sites.filter("team IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL").withColumn("near", _lane_of(F.col("x"), F.col("z"))).filter(F.col("near.d") <= ON_LANE)
    turrets = on_lane.select("match_id", F.col("net_id").alias("other"), F.struct(F.col("near.lane").alias("lane"), (1 - F.col("team")).alias("team")).alias("label"))
    both = F.explode(F.array(F.struct(F.col("source_net_id").alias("unit"), F.col("target_net_id").alias("other")), F.struct(F.col("target_net_id").alias("unit"), F.col("source_net_id").alias("other"))))
    votes = damage.select("match_id", "seq", both.alias("b")).select("match_id", "seq", "b.unit", "b.other").join(units, ["match_id", "unit"]).join(turrets, ["match_id", "other"])
    best = majority_label(votes, ["match_id", "barrack_net_id"], "label", "seq", 1).filter(F.col("n_votes") >= LEAST_VOTES)
    return best.select("match_id", "barrack_net_id", "label.lane", "label.team", F.col("n_votes").alias("votes"))


def lane_units(barracks: DataFrame, deaths: DataFrame, labels: DataFrame) -> DataFrame:
    """(match_id, net_id, lane, team, t0, t1, t1_known): lane units from their first sighting to their first death, or for
    UNIT_LIFE_S; units of barracks without a label are left out.

    ``barracks``: match_id, t, minion_net_id, barrack_net_id; ``deaths``: match_id, killed_net_id, t, seq.
    """
    labelled = barracks.join(labels.select("match_id", "barrack_net_id", "lane", "team"), ["match_id", "barrack_net_id"])
    first = labelled.groupBy("match_id", F.col("minion_net_id").alias("net_id")).agg(F.min(F.struct("t", "lane", "team")).alias("s"))
    fell = deaths.groupBy("match_id", F.col("killed_net_id").alias("net_id")).agg(F.min_by("t", "seq").alias("died"))
    return first.join(fell, ["match_id", "net_id"], "left").select("match_id", "net_id", "s.lane", "s.team", F.col("s.t").alias("t0"), F.coalesce("died", F.col("s.t") + UNIT_LIFE_S).alias("t1"), F.col("died").isNotNull().alias("t1_known"))


def unit_contacts(damage: DataFrame, heroes: DataFrame, units: DataFrame) -> DataFrame:
    """(match_id, t, slot, lane): every exchange of damage between a hero and a lane unit, in either direction.

    ``damage``: match_id, t, source_net_id, target_net_id; ``heroes``: match_id, net_id, slot; ``units``: those of ``lane_units``.
    """
    both = F.explode(F.array(F.struct(F.col("source_net_id").alias("hero"), F.col("target_net_id").alias("unit")), F.struct(F.col("target_net_id").alias("hero"), F.col("source_net_id").alias("unit"))))
    pairs = damage.select("match_id", "t", both.alias("b")).select("match_id", "t", "b.hero", "b.unit")
    slots = heroes.select("match_id", F.col("net_id").alias("hero"), "slot")
    lanes = units.select("match_id", F.col("net_id").alias("unit"), "lane")
    return pairs.join(slots, ["match_id", "hero"]).join(lanes, ["match_id", "unit"]).select("match_id", "t", "slot", "lane")


def _ticks(rows: DataFrame, ticks: DataFrame, first: Column, last: Column) -> DataFrame:
    """``rows`` at each tick from ``first`` to ``last`` within the match (match_id, n_ticks)."""
    joined = rows.join(ticks.select("match_id", "n_ticks"), "match_id").withColumn("__a", F.greatest(first, F.lit(0.0)).cast("int")).withColumn("__b", F.least(last, (F.col("n_ticks") - 1).cast("double")).cast("int"))
    return joined.filter("__b >= __a").withColumn("tick", F.explode(F.sequence("__a", "__b"))).drop("__a", "__b", "n_ticks")


def turret_sources(sites: DataFrame, ticks: DataFrame) -> DataFrame:
    """(match_id, tick, team, x, z, r, class): turrets with a place and a team, at each tick before they fall."""
    placed = sites.filter("team IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL")
    end = F.when(F.col("destroyed_t") == float("inf"), F.lit(1e9)).otherwise(F.ceil("destroyed_t").cast("double") - 1)
    return _ticks(placed, ticks, F.lit(0.0), end).select("match_id", "tick", "team", "x", "z", F.lit(TURRET_SIGHT).alias("r"), F.lit("turret").alias("class"))


def place_on(lane: str, s: Column) -> tuple[Column, Column]:
    """x and z at the fraction ``s`` of a lane's length."""
    x, z = None, None
    for x0, z0, x1, z1, before, whole in reversed(segments(lane)):
        length = ((x1 - x0) ** 2 + (z1 - z0) ** 2) ** 0.5
        f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s * whole - before) / length))
        px, pz = x0 + f * (x1 - x0), z0 + f * (z1 - z0)
        x, z = (px, pz) if x is None else (F.when(s * whole <= before + length, px).otherwise(x), F.when(s * whole <= before + length, pz).otherwise(z))
    return x, z


def unit_sources(units: DataFrame, fronts: DataFrame, ticks: DataFrame) -> DataFrame:
    """(match_id, tick, team, x, z, r, class): lane units at each tick of their life, walking from their end of the lane to
    the front and no farther. ``fronts``: match_id, lane, tick, front (0.5 where there is none)."""
    alive = _ticks(units, ticks, F.ceil("t0").cast("double"), F.floor("t1").cast("double")).join(fronts.select("match_id", "lane", "tick", "front"), ["match_id", "lane", "tick"], "left").withColumn("front", F.coalesce("front", F.lit(0.5)))
    x = z = F.lit(None).cast("double")
    for lane in LANES:
        way = WAVE_SPEED * (F.col("tick") - F.col("t0")) / segments(lane)[0][5]
        s = F.when(F.col("team") == 0, F.least(way, F.col("front"))).otherwise(F.greatest(1 - way, F.col("front")))
        px, pz = place_on(lane, s)
        x, z = F.when(F.col("lane") == lane, px).otherwise(x), F.when(F.col("lane") == lane, pz).otherwise(z)
    return alive.select("match_id", "tick", "team", x.alias("x"), z.alias("z"), F.lit(UNIT_SIGHT).alias("r"), F.lit("unit").alias("class"))
