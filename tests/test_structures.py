import math

from mistrail.functions.geometry import LANES, world
from mistrail.operators import structures as st


def test_turrets(spark):
    turrets = spark.createDataFrame([("m", 1, "Turret_T1_C_07", 1), ("m", 2, "Turret_T2_L_02", 2), ("m", 3, "ChaosTurretShrine_A", 3), ("m", 4, "odd", 4), ("m", 1, "Turret_T1_C_07", 9), ("m", 5, "listed", 6)], "match_id string, net_id long, name string, seq long")
    attacks = spark.createDataFrame([("m", 2, 10.0, 20.0), ("m", 2, 12.0, 22.0), ("m", 2, 900.0, 21.0), ("m", 1, 5.0, 5.0)], "match_id string, source_net_id long, x double, z double")
    deaths = spark.createDataFrame([("m", 2, 80.0, 7), ("m", 2, 70.0, 8), ("m", 99, 3.0, 1)], "match_id string, killed_net_id long, t double, seq long")
    known = spark.createDataFrame([("Turret_T1_C_07", 0, 100.0, 200.0), ("listed", 1, 7.0, 8.0)], "name string, team int, x double, z double")
    got = {r.net_id: r for r in st.turret_sites(turrets, attacks, deaths, known).collect()}
    assert {k: (r.team, r.x, r.z, r.n_attacks, r.destroyed_t) for k, r in got.items()} == {
        1: (0, 100.0, 200.0, 1, math.inf), 2: (1, 12.0, 21.0, 3, 80.0), 3: (1, None, None, 0, math.inf), 4: (None, None, None, 0, math.inf), 5: (1, 7.0, 8.0, 0, math.inf),
    }
    assert [tuple(r) for r in st.turret_report(turrets).collect()] == [("m", 5, 2)]
    ticks = spark.createDataFrame([("m", 100)], "match_id string, n_ticks int")
    lit = [(r.tick, r.x) for r in st.turret_sources(st.turret_sites(turrets, attacks, deaths, known), ticks).collect()]
    assert sorted(t for t, x in lit if x == 12.0) == list(range(80)) and sorted(t for t, x in lit if x == 7.0) == list(range(100)) and len(lit) == 280


def test_barracks_units_and_contacts(spark):
    (ax, az), (bx, bz) = world(LANES["mid"][1]), world(LANES["top"][3])
    sites = spark.createDataFrame([("m", 1, 1, ax, az), ("m", 2, 0, bx, bz), ("m", 3, 0, 9000.0, 3000.0), ("m", 4, None, ax, az)], "match_id string, net_id long, team int, x double, z double")
    barracks = spark.createDataFrame([("m", 65.0, 10, 500), ("m", 64.0, 10, 500), ("m", 95.0, 11, 500), ("m", 66.0, 20, 600), ("m", 66.0, 30, 700)], "match_id string, t double, minion_net_id long, barrack_net_id long")
    hits = [(10, 1)] * 3 + [(1, 11)] * 3 + [(10, 2)] * 2 + [(20, 2)] * 5 + [(30, 3)] * 9 + [(30, 1)] * 4 + [(77, 10), (20, 77), (77, 1), (77, 30)]
    damage = spark.createDataFrame([("m", 70.0 + k, k, a, b) for k, (a, b) in enumerate(hits)], "match_id string, t double, seq long, source_net_id long, target_net_id long")
    labels = st.barrack_labels(barracks, damage, sites)
    assert {(r.barrack_net_id, r.lane, r.team, r.votes) for r in labels.collect()} == {(500, "mid", 0, 6), (600, "top", 1, 5)}
    deaths = spark.createDataFrame([("m", 10, 90.0, 5), ("m", 10, 92.0, 6)], "match_id string, killed_net_id long, t double, seq long")
    units = st.lane_units(barracks, deaths, labels)
    assert {tuple(r) for r in units.collect()} == {("m", 10, "mid", 0, 64.0, 90.0, True), ("m", 11, "mid", 0, 95.0, 150.0, False), ("m", 20, "top", 1, 66.0, 121.0, False)}
    heroes = spark.createDataFrame([("m", 77, 3)], "match_id string, net_id long, slot int")
    assert sorted((r.slot, r.lane) for r in st.unit_contacts(damage, heroes, units).collect()) == [(3, "mid"), (3, "top")]
    fronts = spark.createDataFrame([("m", "mid", t, 0.15) for t in range(60, 110)], "match_id string, lane string, tick int, front double")
    lit = {(r.team, r.tick, round(r.z)): r for r in st.unit_sources(units, fronts, spark.createDataFrame([("m", 120)], "match_id string, n_ticks int")).collect()}
    mid = sorted((k[1], r.x, r.z) for k, r in lit.items() if k[0] == 0 and k[1] <= 90)
    assert [t for t, _, _ in mid] == list(range(64, 91)) and math.dist(mid[0][1:], world(LANES["mid"][0])) < 1e-6
    # A unit walks at its speed and stops at the front.
    assert abs(math.dist(mid[0][1:], mid[2][1:]) - 650) < 1e-6 and mid[-1][1:] == mid[-2][1:]
    assert {k[1] for k in lit if k[0] == 1} == set(range(66, 120))
