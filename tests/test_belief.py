import numpy as np
import pytest
from pyspark.sql import functions as F

from mistrail.functions.filtering import MODELS, MOVES, BeliefModel, Filters, Ground, Histogram, Sight, detection, normalised
from mistrail.functions.ground import Raster, walk_distances, walks_from, walks_within
from mistrail.functions.mixing import divergence, fit, raster
from mistrail.functions.scoring import Scorer
from mistrail.operators.belief import LEVELS, SCORES, WHOLE, belief_sums, beliefs, densest, entropy_bits, scored
from mistrail.plans.belief_queries import h14_belief_checks, h16_ablation


def world16(seed=3):
    """A wall with a door of one cell and eight random blocks."""
    rng = np.random.default_rng(seed)
    open_cells = np.ones((16, 16), bool)
    open_cells[8] = False
    open_cells[8, 7] = True
    for i, j in rng.integers(0, 16, (8, 2)):
        open_cells[i, j] = False
    open_cells[2, 2] = True
    return Ground(Raster(open_cells, ~open_cells, np.full((16, 16), -1)), 100.0)


def test_steps_follow_the_matrix():
    ground = world16()
    m = ground.matrix(0.1)
    assert np.allclose(m.sum(1), 1)
    model, rng = BeliefModel(motion="diffusion", persistence=0.0), np.random.default_rng(1)
    for cell in ground.open[::37]:
        to, _ = ground.step(np.full(200_000, cell), np.full(200_000, 8), None, model, rng.random(200_000))
        assert abs(np.bincount(to, minlength=256) / 200_000 - m[cell]).max() < 0.006
    blocked = np.zeros((4, 4), bool)
    blocked[1, 1] = True
    alone = Ground(Raster(blocked, ~blocked, np.full((4, 4), -1)), 100.0)
    assert alone.step(np.array([5]), np.array([8]), None, model, np.array([0.5]))[0].tolist() == [5] and alone.matrix(0.1)[5, 5] == 1


def test_goals_and_headings_bias_the_steps():
    ground = Ground(Raster(np.ones((21, 21), bool), np.zeros((21, 21), bool), np.full((21, 21), -1)), 100.0)
    rng, n = np.random.default_rng(2), 50_000
    start, goal = np.full(n, 10 * 21 + 10), np.full(n, 20 * 21 + 10)
    to, _ = ground.step(start, np.full(n, 8), goal, BeliefModel(persistence=0.0), rng.random(n))
    assert (to // 21 - 10).mean() > 0.2 and abs((to % 21 - 10).mean()) < 0.02
    to, heading = ground.step(start, np.full(n, 6), None, BeliefModel(persistence=1.0), rng.random(n))
    share = np.bincount(heading, minlength=9) / n
    assert abs(share[6] / share[1] - 2) < 0.15 and abs(share[8] - 0.1) < 0.01


@pytest.mark.parametrize("particles,bound", [(2000, 0.25), (50_000, 0.06)])
def test_filter_equals_exact_bayes(particles, bound):
    """Against the forward pass over all 256 cells: walk, sightings, and their absence under a moving source."""
    ground = world16()
    model = BeliefModel(motion="diffusion", persistence=0.0, particles=particles, deplete=0.0)
    home = np.array([2 * 16 + 2])
    filters = Filters(ground, model, home, [home], 1.0, np.random.default_rng(5))
    exact = np.zeros(256)
    exact[home[0]] = 1
    step = np.linalg.matrix_power(ground.matrix(model.stay), model.sub_steps)
    worst = 0.0
    for tick in range(25):
        pd = detection(ground, np.array([200.0 + 40 * tick]), np.array([500.0]), np.array([310.0]), model)
        seen = tick == 9
        observed = 5 * 16 + 6 if seen else -1
        filters.tick(tick, np.array([True]), np.array([seen]), np.array([observed]), pd[None])
        exact = exact @ step
        if seen:
            exact = np.zeros(256)
            exact[observed] = 1
        else:
            exact = exact * (1 - pd)
            exact /= exact.sum()
        got = np.bincount(filters.cell[0], normalised(filters.logw)[0], 256)
        worst = max(worst, abs(got - exact).sum() / 2)
    assert worst < bound and filters.n_resampled > 0


def test_detection_inside_edge_and_off_the_map():
    ground = Ground(Raster(np.ones((20, 20), bool), np.zeros((20, 20), bool), np.full((20, 20), -1)), 100.0)
    pd = detection(ground, np.array([1000.0]), np.array([1000.0]), np.array([400.0]), BeliefModel()).reshape(20, 20)
    assert pd[10, 10] == 0.98 and pd[13, 10] == 0.75 and pd[15, 10] == 0 and detection(ground, np.zeros(0), np.zeros(0), np.zeros(0), BeliefModel()).sum() == 0
    assert detection(ground, np.array([50.0]), np.array([50.0]), np.array([300.0]), BeliefModel()).reshape(20, 20)[0, 0] == 0.98


def test_models_and_their_limits():
    with pytest.raises(ValueError):
        BeliefModel(stay=1.0)
    with pytest.raises(ValueError):
        BeliefModel(particles=400)
    assert len({m.name for m in MODELS}) == 7
    ground = world16()
    # A walk is longer than the way as the crow flies: the wall has one door.
    cells = ground.within(2 * 16 + 2, 600.0)
    assert all(c // 16 <= 8 for c in cells) and 9 * 16 + 2 not in ground.within(2 * 16 + 2, 800.0) and len(ground.within(2 * 16 + 2, 0.0)) >= 1


def test_histogram_entropy_and_density():
    ground = Ground(Raster(np.ones((64, 64), bool), np.zeros((64, 64), bool), np.full((64, 64), -1)), 230.0)
    h = Histogram(ground, 0.25)
    p = h(np.full((2, 4), 33 * 64 + 33), np.full((2, 4), 0.25))
    assert abs(p.sum(1) - 1).max() < 1e-12 and abs(p[0, 16 * 32 + 16] - 0.75) < 1e-12 and (p[0] > 0).sum() == 9
    assert entropy_bits(np.full((1, 1024), 1 / 1024), np.array([50.0]), 1024)[0] == 10
    assert densest(p, 0.9).tolist() == [6, 6] and densest(p, 0.75).tolist() == [1, 1]


def test_beliefs_of_a_match(spark):
    rows = []
    for tick in range(12):
        for slot, team in ((0, 1), (5, 0)):
            seen = tick % 6 == 0 and slot == 0
            rows.append(("m", slot, team, "mid" if slot else None, tick, not (slot == 5 and 4 <= tick < 7), seen, 3000.0 + 100 * tick if seen else None, 3000.0 if seen else None))
    rows += [(None, 1, 1, None, 1, True, False, None, None), ("m", None, 1, None, 1, True, False, None, None)]
    obs = spark.createDataFrame(rows, "match_id string, slot int, team int, role string, tick int, alive boolean, seen boolean, x double, z double")
    sources = spark.createDataFrame([("m", t, 1, 9000.0, 9000.0, 1350.0) for t in range(12)], "match_id string, tick int, team int, x double, z double, r double")
    raster = Raster(np.ones((64, 64), bool), np.zeros((64, 64), bool), np.full((64, 64), -1))
    got = beliefs(obs, sources, MODELS, raster, 230.625)
    found = {(r.model, r.slot, r.tick): r for r in got.collect()}
    assert len(found) == 7 * 2 * 12
    assert all(abs(sum(r.p) - 1) < 1e-9 and len(r.p) == len(r.bins) and 0 <= r.entropy <= 10 for r in found.values())
    # A sighting is a point, spread over its neighbours only; the uniform model knows none.
    assert found["full", 0, 6].area <= 6 and found["full", 0, 11].area > found["full", 0, 7].area and found["uniform", 0, 6].area > 500
    assert {tuple(found["full", 5, t].bins) for t in (4, 5, 6)} == {tuple(found["full", 5, 4].bins)}
    again = {(r.model, r.slot, r.tick): r.p for r in beliefs(obs, sources, MODELS[:3], raster, 230.625).collect()}
    assert all(found[k].p == p for k, p in again.items())
    truth = spark.createDataFrame([("m", 0, 8, found["full", 0, 8].bins[0]), ("m", 0, 6, 1), ("m", 0, 9, 1023)], "match_id string, slot int, tick int, true_bin int")
    s = {(r.model, r.tick): r for r in scored(got, truth).collect()}
    assert {t for _, t in s} == {8, 9} and s["full", 9].p_true == 0 and abs(s["full", 9].pit - 1) < 1e-9 and s["full", 8].p_true == found["full", 0, 8].p[0]
    assert beliefs(obs.limit(0), sources, MODELS[-1:], raster, 230.625).collect() == []


def test_mixtures_of_beliefs():
    rng = np.random.default_rng(4)
    middles = (np.stack(np.divmod(np.arange(1024), 32), 1) + 0.5) * 461.25
    points = np.concatenate([rng.normal((3000, 3000), 300, (400, 2)), rng.normal((11000, 8000), 600, (600, 2))])
    w, c, s = fit(points, np.full(1000, 1e-3), 2, 5)
    order = np.argsort(c[:, 0])
    assert np.allclose(w[order], [0.4, 0.6]) and np.allclose(c[order], [(3000, 3000), (11000, 8000)], atol=100) and np.allclose(s[order], [300, 600], rtol=0.1)
    assert abs((raster(w, c, s, middles, 1.0) * 461.25**2).sum() - 1) < 0.05
    # Fewer points than parts: the others stay where they are, without weight.
    w, c, s = fit(points[:3], np.array([0.2, 0.5, 0.3]), 16, 5)
    assert sorted(np.round(w[w > 0], 6)) == [0.2, 0.3, 0.5] and s.max() == 0
    p = rng.random(1024)
    assert divergence(p, p) < 1e-9 and divergence(p, np.ones(1024)) > 0.05
    again = fit(points, np.full(1000, 1e-3), 2, 0, np.array([[3000.0, 3000.0], [11000.0, 8000.0]]))[1]
    assert again.tolist() == [[3000.0, 3000.0], [11000.0, 8000.0]]


def test_kernels_equal_their_definitions():
    """Steps by gathered weights, walks of a window and lit cells of all sources at once, against the plain formulas."""
    ground, rng, n = world16(), np.random.default_rng(7), 4000
    model = BeliefModel()
    cell, heading, goal, draw = rng.choice(ground.open, n), rng.integers(0, 9, n), rng.choice(ground.open, n), rng.random(n)
    w = ground.weight[cell] * np.where(np.arange(8) == heading[:, None], 2.0, 1.0)
    to = np.stack([goal // 16 - cell // 16, goal % 16 - cell % 16], 1)
    cosine = to / np.maximum(np.hypot(*to.T), 1e-9)[:, None] @ (MOVES / np.hypot(*MOVES.T)[:, None]).T
    upto = np.cumsum(w * np.exp(0.45 * cosine), 1)
    pick = (draw[:, None] * upto[:, -1:] / 0.9 >= upto).sum(1)
    got, found = ground.step(cell, heading, goal, model, draw)
    assert (found == pick).mean() > 0.999
    assert (got == np.where(found == 8, cell, ground.to[cell, np.minimum(found, 7)])).all()
    for cell in ground.open[::23].tolist():
        whole = walk_distances(ground.raster.open, *divmod(cell, 16))
        for most in (0, 150, 700, 10**6):
            far, i, j = walks_within(ground.raster.open, *divmod(cell, 16), most)
            want = np.where(whole <= most, whole, -1)
            assert (far == want[i : i + far.shape[0], j : j + far.shape[1]]).all() and (far >= 0).sum() == (want >= 0).sum()
    x, z, r = np.append(rng.uniform(-300, 1900, 40), [np.nan, 800.0]), np.append(rng.uniform(-300, 1900, 40), [5.0, 800.0]), np.append(rng.uniform(0, 900, 40), [99.0, 1e7])
    sight = Sight(ground, x, z, r, model)
    at = np.stack(np.meshgrid(np.arange(16), np.arange(16), indexing="ij"), 2) * 100.0 + 50
    for some in ([], [3], [0, 5, 9], list(range(41)), [41]):
        lit = np.zeros((9, 16, 16), bool)
        for k, move in enumerate([(0, 0), *MOVES]):
            a, b = np.moveaxis(at + np.array(move) * model.ring, 2, 0)
            lit[k] = (a < 0) | (a >= 1600) | (b < 0) | (b >= 1600)
            for s in some:
                lit[k] |= (a - x[s]) ** 2 + (b - z[s]) ** 2 <= r[s] ** 2
        assert (sight.detection(some).reshape(16, 16) == np.where(lit[0], np.where(lit.all(0), 0.98, 0.75), 0.0)).all()


def test_no_work_for_particles_that_a_sighting_places(monkeypatch):
    """h14_beliefs took most of its time for steps of heroes in sight, and for sources looked at by every hero and cell."""
    ground, walkers = world16(), []
    step = ground.step
    monkeypatch.setattr(ground, "step", lambda cell, *rest: walkers.append(len(cell)) or step(cell, *rest))
    model = BeliefModel()
    filters = Filters(ground, model, np.array([34, 34]), [np.array([34]), np.array([200])], 1.0, np.random.default_rng(1))
    for tick in range(5):
        filters.tick(tick, np.array([True, True]), np.array([True, tick == 4]), np.array([34, 35]), np.zeros((1, 256)), np.zeros(2, int))
    assert walkers == [1024] * 8 and (filters.cell == [[34], [35]]).all() and (filters.weight == 1 / 1024).all()


def test_readings_in_the_task_equal_those_of_the_arrays(spark):
    """Bins and probabilities of every belief were sent back, and shuffled to be scored."""
    rows = [("m", slot, 1, None, tick, tick != 3, tick % 6 == 0, 3000.0, 3000.0) for tick in range(9) for slot in (0, 1)]
    obs = spark.createDataFrame(rows, "match_id string, slot int, team int, role string, tick int, alive boolean, seen boolean, x double, z double")
    sources = spark.createDataFrame([("m", t, 1, 3500.0, 3000.0, 900.0) for t in range(9)], "match_id string, tick int, team int, x double, z double, r double")
    raster = Raster(np.ones((64, 64), bool), np.zeros((64, 64), bool), np.full((64, 64), -1))
    truth = spark.createDataFrame([("m", slot, tick, 7 * 32 + 6 + slot) for tick in (1, 2, 3, 5, 6, 7) for slot in (0, 1)], "match_id string, slot int, tick int, true_bin int")
    arrays = {(r.model, r.slot, r.tick): r for r in scored(beliefs(obs, sources, MODELS[-2:], raster, 230.625), truth, every=True).collect()}
    read = beliefs(obs, sources, MODELS[-2:], raster, 230.625, bins=False, known=truth, read=SCORES)
    assert read.columns == ["model", "match_id", "slot", "tick", "alive", "seen", "ess", "entropy", "area", "p_true", "pit"]
    got = {(r.model, r.slot, r.tick): r for r in read.collect()}
    assert got.keys() == arrays.keys() and sum(r.p_true is not None for r in got.values()) == 16
    assert all((r.p_true, r.pit, r.area) == (arrays[k].p_true, arrays[k].pit, arrays[k].area) for k, r in got.items())


def test_beliefs_are_checked_where_they_arise(spark, small):
    """h14_belief_checks: all bins and probabilities went to Spark, only to be summed up there."""
    size, p = np.array([2, 2, 2, 0, 2, 1]), np.array([0.5, 0.5, 0.5, 0.4, 1.5, -0.5, np.nan, 1.0, 1.0])
    whole = lambda n, p: WHOLE.of(np.ones(len(n), bool), n, np.arange(9, dtype=np.int32), p, {})[0].tolist()
    assert whole(size, p) == [True, False, False, False, False, True] and not any(whole(size, p[:-1])) and not any(whole(size[:-1], p))
    plan = h14_belief_checks(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "whole#" in plan and "bins#" not in plan


def test_sources_that_stay_equal_those_of_each_tick(spark):
    """Wards went to the filter once for each tick of their lives."""
    rows = [("m", slot, team, None, tick, True, tick == 0, 3000.0, 3000.0) for tick in range(9) for slot, team in ((0, 1), (5, 0))]
    obs = spark.createDataFrame(rows, "match_id string, slot int, team int, role string, tick int, alive boolean, seen boolean, x double, z double")
    spans = [("m", -3, 4, 1, 3500.0, 3000.0, 900.0), ("m", 2, 99, 1, 2500.0, 2500.0, 700.0), ("m", 5, None, 0, 3000.0, 3000.0, 400.0), ("m", 7, 6, 0, 3000.0, 3000.0, 9000.0), ("m", 1, 8, None, 1.0, 1.0, 9e4), ("m", 1, 8, 7, 1.0, 1.0, 9e4)]
    lit = spark.createDataFrame(spans, "match_id string, tick int, last int, team int, x double, z double, r double")
    single = lit.withColumn("tick", F.explode(F.expr("CASE WHEN last IS NULL THEN array(tick) WHEN last >= tick THEN sequence(tick, last) END"))).drop("last")
    raster = Raster(np.ones((64, 64), bool), np.zeros((64, 64), bool), np.full((64, 64), -1))
    of = lambda sources: sorted((r.slot, r.tick, r.p, r.bins) for r in beliefs(obs, sources, MODELS[-1:], raster, 230.625).collect())
    assert of(lit) == of(single) and of(lit) != of(lit.filter("team = 7"))


def test_strides_equal_the_formula():
    ground, rng, n = world16(), np.random.default_rng(9), 4000
    model, goals = BeliefModel(), rng.choice(ground.open, 5)
    cell, heading, goal, draw = rng.choice(ground.open, n), rng.integers(0, 9, n), rng.choice(goals, n), rng.random(n)
    for some in (goals[:2], goals):
        strides = ground.prepare(some, model)
    assert [a.tolist() for a in ground.step(cell, heading, goal, model, draw, strides)] == [a.tolist() for a in ground.step(cell, heading, goal, model, draw)]
    assert (strides.close.take(strides.first.take(goal) + cell) == ground.close(model.arrive).take(ground.way(cell, goal))).all()


def test_sums_of_a_match_equal_those_of_its_beliefs(spark, small):
    """h16_ablation: each match was sent once for each of the seven models, and a row for every belief came back."""
    rows = [(m, slot, slot // 2, None, tick, not (slot == 1 and 3 <= tick < 6), (tick + slot) % 7 == 0, 3000.0 + 90 * tick, 3000.0) for m in ("m", "n") for tick in range(-1, 40) for slot in (0, 1, 2) if tick != 9]
    obs = spark.createDataFrame(rows, "match_id string, slot int, team int, role string, tick int, alive boolean, seen boolean, x double, z double")
    sources = spark.createDataFrame([("m", t, t + 5, k % 2, 2500.0 + 300 * k, 3300.0, 1100.0) for t in range(0, 40, 5) for k in range(4)], "match_id string, tick int, last int, team int, x double, z double, r double")
    blocked = np.zeros((64, 64), bool)
    blocked[20:44, 30] = blocked[5:9, 5:60] = True
    raster = Raster(~blocked, blocked, np.full((64, 64), -1))
    truth = spark.createDataFrame([("m", slot, tick, 7 * 32 + 6 + slot + tick // 9) for tick in range(38) for slot in (0, 1, 2) if tick % 5], "match_id string, slot int, tick int, true_bin int")
    want = beliefs(obs, sources, MODELS, raster, 230.625, bins=False, known=truth, read=SCORES).toPandas()
    got = {(r.model, r.match_id): r for r in belief_sums(obs.join(truth, ["match_id", "slot", "tick"], "left"), sources, MODELS, raster, 230.625, 0.2).collect()}
    assert len(got) == 14 and sum(r.n for r in got.values()) == 7 * want[want.model == "full"].p_true.count()
    for key, of in want.groupby(["model", "match_id"]):
        r, rated = got[key], of[of.p_true.notna()]
        assert (r.n_rows, r.n_dark, r.n_alive, r.n_dark_alive, r.n) == (len(of), (~of.seen).sum(), of.alive.sum(), (of.alive & ~of.seen).sum(), len(rated))
        nll = -np.log(np.maximum(rated.p_true, 0.5 / 1024) / 0.2)
        assert np.allclose((r.nll, r.entropy, r.area), (nll.sum(), rated.entropy.sum(), rated.area.sum()), rtol=1e-12)
        assert all((rated.pit <= q - 1e-9).sum() <= n <= (rated.pit <= q + 1e-9).sum() for q, n in zip(LEVELS, r.n_covered))
    plan = h16_ablation(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "n_covered" in plan and "[uniform,disc" not in plan and "p_true" not in plan


def test_counted_particles_are_scored_like_weighed_ones():
    rng = np.random.default_rng(3)
    open_cells = rng.random((64, 64)) < 0.8
    open_cells[32:] = False
    ground = Ground(Raster(open_cells, ~open_cells, np.full((64, 64), -1)), 230.0)
    cell = np.concatenate([rng.integers(0, 4096, (30, 1024)), np.clip(rng.normal(700, 90, (30, 1024)), 0, 4095).astype(int), np.repeat(rng.integers(0, 4096, (9, 1)), 1024, 1)])
    true, scorer = rng.integers(0, 1024, len(cell)), Scorer(ground, BeliefModel(), 0.9)
    even, weighed = scorer(cell, true), scorer(cell, true, np.full(cell.shape, 1 / 1024))
    assert (even[0] == weighed[0]).all() and (even[3] == weighed[3]).all() and np.allclose(even[1:3], weighed[1:3], atol=1e-12)


def test_balls_of_many_cells_equal_those_of_one():
    ground = world16()
    far = walks_from(ground.raster.open, ground.open)
    assert all((row.reshape(16, 16) == walk_distances(ground.raster.open, *divmod(cell, 16))).all() for cell, row in zip(ground.open.tolist(), far))
    alone = world16()
    ground.prepare_balls(np.arange(256))
    assert all(ground.within(c, r).tolist() == alone.within(c, r).tolist() for c in range(0, 256, 7) for r in (0.0, 100.0, 140.0, 141.5, 555.0, 1e5)) and len(ground.whole_balls) == 256 and not ground.balls
