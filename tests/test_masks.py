"""Team masks hold every tick and are the cells within a source's radius."""

from collections import defaultdict

import numpy as np

from mistrail.plans import vision


def brute_force(rows):
    """{(match_id, tick, team): grid of lit cells}"""
    middle = (np.arange(vision.SIDE) + 0.5) * vision.CELL
    grids = defaultdict(lambda: np.zeros((vision.SIDE, vision.SIDE), bool))
    for r in rows:
        dx, dz = middle - r.x, middle - r.z
        grids[r.match_id, r.tick, r.team] |= dx[:, None] * dx[:, None] + dz[None] * dz[None] <= r.r * r.r
    return grids


def test_masks_of_every_tick_equal_brute_force(spark, small):
    want = {k: g for k, g in brute_force(vision.sources(spark, small).collect()).items() if g.any()}
    got = defaultdict(lambda: np.zeros((vision.SIDE, vision.SIDE), bool))
    for r in vision.f7_team_masks_per_tick(spark, small).collect():
        got[r.match_id, r.tick, r.team][r.word] = [(r.low if j < 32 else r.high) >> j % 32 & 1 for j in range(vision.SIDE)]
    assert set(got) == set(want) and {t for _, t, _ in got} >= set(range(100))
    assert all((got[k] == want[k]).all() for k in want)
    areas = {(r.match_id, r.tick, r.team): r.n_cells for r in vision.f9_mask_areas_per_tick(spark, small).collect()}
    assert areas == {k: g.sum() for k, g in want.items()}
    coarse = {(r.match_id, r.tick, r.team): (r.n_lit, r.cells % 2**64) for r in vision.k5_coarse_masks_per_tick(spark, small).collect()}
    blocks = {k: g.reshape(8, 8, 8, 8).any((1, 3)).ravel() for k, g in want.items()}
    assert coarse == {k: (b.sum(), sum(1 << i for i in map(int, b.nonzero()[0]))) for k, b in blocks.items()}
