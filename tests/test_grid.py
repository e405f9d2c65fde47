import numpy as np

from mistrail.operators import regular_grid as rg
from mistrail.operators.regular_grid import missing_stretches, positions_on_grid

GRID, MARKS, ANCHORS = "match_id string, slot int, n_ticks int, block long", "match_id string, slot int, tick int, x double, z double, kind string", "match_id string, slot int, t double, x double, z double, block string"


def grid(spark, marks, anchors, n=60):
    return positions_on_grid(spark.createDataFrame([("m", 0, n, 1)], GRID), spark.createDataFrame(marks, MARKS), spark.createDataFrame(anchors, ANCHORS))


def test_a_line_is_reproduced_and_gaps_are_filled_or_marked(spark):
    marks = [("m", 0, k, 100.0 * k, 50.0 + k, "") for k in range(60) if not 10 <= k < 14 and not 30 <= k < 40]
    rows = sorted(grid(spark, marks, []).collect(), key=lambda r: r.tick)
    assert [r.tick for r in rows] == list(range(60))
    assert [r.tick for r in rows if r.missing] == list(range(30, 40))
    for r in rows:
        if r.missing:
            assert r.x is None and r.z is None
        else:
            assert abs(r.x - 100.0 * r.tick) < 1e-6 and abs(r.z - 50.0 - r.tick) < 1e-6
    assert [(r.first_tick, r.last_tick) for r in missing_stretches(grid(spark, marks, [])).collect()] == [(30, 39)]


def test_weighted_fit_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 59.9, 80))
    x = rng.uniform(0, 1000, 80)
    rows = grid(spark, [], [("m", 0, float(a), float(b), 1.0, "") for a, b in zip(t, x)]).collect()
    h = rg.HALF_WIDTH
    # Readings of one eighth of a tick are averaged beforehand.
    cells = {}
    for a, b in zip(t, x):
        cells.setdefault(int(a * rg.CELLS), []).append((a, b))
    mean = [(np.mean([a for a, _ in c]), np.mean([b for _, b in c]), len(c)) for c in cells.values()]
    for r in rows:
        near = [(a - r.tick, b, w) for a, b, w in mean if abs(a - r.tick) < h and abs(int(a) - r.tick) <= h]
        if r.missing or len(near) < 2:
            continue
        d, y = np.array([n[0] for n in near]), np.array([n[1] for n in near])
        k = np.array([n[2] for n in near]) * 0.75 * (1 - (d / h) ** 2)
        a = np.stack([np.ones_like(d), d], 1) * np.sqrt(k)[:, None]
        assert abs(np.linalg.lstsq(a, y * np.sqrt(k), rcond=None)[0][0] - r.x) < 1e-5 * max(1, abs(r.x))


def test_blocks_join(spark, monkeypatch):
    monkeypatch.setattr(rg, "BLOCK", 16)
    marks = [("m", 0, k, 10.0 * k, 5.0, "") for k in range(100) if not 12 <= k < 70 and k != 96]
    on = grid(spark, marks, [], 100)
    rows = sorted(on.collect(), key=lambda r: r.tick)
    assert [r.tick for r in rows] == list(range(100))
    assert all(abs(r.x - 10.0 * r.tick) < 1e-6 for r in rows if not r.missing)
    assert [(r.first_tick, r.last_tick) for r in missing_stretches(on).collect()] == [(12, 69)]


def test_nulls_empty_and_unusable(spark):
    marks = [("m", 0, 1, None, float("nan"), ""), (None, 0, 1, 1.0, 1.0, ""), ("m", None, 2, 1.0, 1.0, ""), ("m", 0, -3, 1.0, 1.0, ""), ("n", 0, 1, 1.0, 1.0, "")]
    anchors = [("m", 0, float("nan"), 1.0, 1.0, ""), ("m", 0, None, 1.0, 1.0, ""), ("m", 0, 99.0, 1.0, 1.0, "")]
    rows = sorted(grid(spark, marks, anchors, 8).collect(), key=lambda r: r.tick)
    assert [(r.tick, r.missing, r.x) for r in rows] == [(0, False, None), (1, False, None), *[(k, True, None) for k in range(2, 8)]]
    none = spark.createDataFrame([], GRID)
    assert positions_on_grid(none, spark.createDataFrame(marks, MARKS), spark.createDataFrame(anchors, ANCHORS)).collect() == []


def test_copies_of_a_hot_match_change_nothing(spark):
    marks = spark.createDataFrame([("m", 0, k, 10.0 * k, 5.0, "") for k in range(20) for _ in range(1 + 30 * (k == 7))], MARKS)
    base = spark.createDataFrame([("m", 0, 20, 1)], GRID)
    none = spark.createDataFrame([], ANCHORS)
    plain, hot = (sorted((r.tick, round(r.x, 6), r.n_readings) for r in positions_on_grid(base, marks, none, hot_rows=n).collect()) for n in (10**6, 10))
    assert plain == hot and len(plain) == 20
