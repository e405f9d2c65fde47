import random

import numpy as np

from mistrail.functions.mixing import divergence, fit, raster
from mistrail.plans.belief_exports import _MIDDLES, LOSSES, MIXTURES, PARTS, RASTERS, ROUNDS
from mistrail.plans.belief_queries import BIN
from mistrail.functions.filtering import BeliefModel
from mistrail.functions.ground import Raster
from mistrail.operators.belief import beliefs
from mistrail.operators.codec import decode, encode
from mistrail.operators.mixture import mixtures


def test_codes_come_back(spark):
    rng = random.Random(1)
    rows = [(k, t, rng.choice([None, rng.randrange(4096), 0, 4095]), "") for k in (1, 2, None) for t in range(150)]
    df = spark.createDataFrame(rows, "k long, t int, v int, frame_no string")
    back = decode(encode(df, ["k"], "t", "v"), ["k"], "t").collect()
    assert len(back) == sum(r[2] is not None for r in rows)
    assert all(r.from_delta == r.v and r.from_xor == r.v and 0 <= r.delta < 4096 for r in back)
    assert all(r.delta == r.v for r in back if r.t % 64 == 0)


def test_mixture_equals_plain_k_means(spark):
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(c, 40, (60, 2)) for c in ((200, 200), (800, 300), (500, 800))])
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in pts] + [("m", None, 1.0), ("m", float("nan"), 1.0)], "k string, x double, z double")
    centres = np.array([((i + 0.5) * 1000 / 3, (j + 0.5) * 1000 / 3) for i in range(3) for j in range(3)])
    for step in range(5):
        near = ((pts[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        if step < 4:
            centres = np.array([pts[near == c].mean(0) if (near == c).any() else centres[c] for c in range(9)])
    got = {r.component: r for r in mixtures(df, ["k"], "x", "z", 1000.0).collect()}
    assert set(got) == set(near)
    for c, r in got.items():
        own = pts[near == c]
        assert np.allclose([r.cx, r.cz, r.weight], [*own.mean(0), len(own) / len(pts)])
        assert np.isclose(r.sigma, np.sqrt(((own - own.mean(0)) ** 2).sum(1).mean() / 2), atol=1e-4)


def test_beliefs_use_sightings_and_their_absence_only(spark):
    seen = [("m", 0, 1, None, t, True, t < 3, 3000.0 if t < 3 else None, 3000.0 if t < 3 else None) for t in range(31)]
    observed = spark.createDataFrame(seen, "match_id string, slot int, team int, role string, tick int, alive boolean, seen boolean, x double, z double")
    lit = spark.createDataFrame([("m", t, 1, 3000.0, 3000.0, 2500.0) for t in range(31)], "match_id string, tick int, team int, x double, z double, r double")
    raster = Raster(np.ones((64, 64), bool), np.zeros((64, 64), bool), np.full((64, 64), -1))
    run = lambda df: beliefs(df, lit, [BeliefModel("with"), BeliefModel("without", negative=False)], raster, 14_760 / 64).collect()
    rows = run(observed)
    assert len({(r.model, r.tick) for r in rows}) == len(rows) == 62 and all(abs(sum(r.p) - 1) < 1e-9 for r in rows)
    near = lambda b: ((b // 32 + 0.5) * 461.25 - 3000) ** 2 + ((b % 32 + 0.5) * 461.25 - 3000) ** 2 < 2000**2
    inside = lambda m: sum(p for r in rows if r.model == m and r.tick == 15 for b, p in zip(r.bins, r.p) if near(b))
    assert inside("with") < 0.5 * inside("without")
    assert sorted(rows) == sorted(run(observed))
    assert run(observed.limit(0)) == []


def test_mixtures_in_the_task_equal_those_of_one_belief():
    """k3, k7 and l8 fitted, rastered and sent everything for each row; each now makes what it gives, null for rows not asked about."""
    rng = np.random.default_rng(2)
    size = np.array([30, 4, 50])
    bins = np.concatenate([np.sort(rng.choice(1024, n, replace=False)) for n in size]).astype(np.int32)
    p = np.concatenate([rng.dirichlet(np.ones(n)) for n in size])
    asked = np.array([True, False, True])
    weight, cx, cz, sigma = MIXTURES.of(asked, size, bins, p, {})
    (kl,), (lit, v) = LOSSES.of(asked, size, bins, p, {}), RASTERS.of(asked, size, bins, p, {})
    assert [c.is_valid().to_pylist() for c in (weight, sigma, kl, lit, v)] == [[True, False, True]] * 5
    for k, at in ((0, slice(0, 30)), (2, slice(34, 84))):
        w, c, s = fit(_MIDDLES[bins[at]], p[at], PARTS, ROUNDS)
        q = raster(w, c, s, _MIDDLES, BIN / 2)
        assert (weight[k].as_py(), cx[k].as_py(), cz[k].as_py(), sigma[k].as_py()) == (w.tolist(), c[:, 0].tolist(), c[:, 1].tolist(), s.tolist())
        assert kl[k].as_py() == divergence(np.bincount(bins[at], p[at], 1024), q) and lit[k].as_py() == np.flatnonzero(q / q.max() >= 0.1).tolist() and max(v[k].as_py()) == 1
    none = MIXTURES.of(np.zeros(3, bool), size, bins, p, {})
    assert all(c.null_count == 3 for c in none)
