import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mistrail.functions.ground import CORNER, STEP, Raster, components, fields_of_view, packed, walk_distances
from mistrail.operators.field_of_view import look_up, united, view_table, views
from mistrail.operators.terrain import brush_patches, collected, distances_from, resampled


def raster(side=40, walls=(), brush=()):
    r = Raster(np.ones((side, side), bool), np.zeros((side, side), bool), np.full((side, side), -1, np.int32))
    for i, j in walls:
        r.blocks[i, j], r.open[i, j] = True, False
    for i, j, patch in brush:
        r.brush[i, j] = patch
    return r


def view(r, i, j, radius, patch=None):
    return fields_of_view(r, np.array([i]), np.array([j]), np.array([r.brush[i, j] if patch is None else patch]), radius)[0]


def disc(radius):
    d = np.arange(-int(radius), int(radius) + 1)
    return d[:, None] ** 2 + d[None] ** 2 <= radius * radius


def by_segments(r, i, j, radius):
    """Whether the segment between the middles passes through the inside of no cell on the way that blocks."""
    reach = int(radius)
    own = r.brush[i, j]
    out = np.zeros((2 * reach + 1,) * 2, bool)
    stops = lambda a, b: not (0 <= a < r.side and 0 <= b < r.side) or r.blocks[a, b] or (r.brush[a, b] >= 0 and r.brush[a, b] != own)
    for di in range(-reach, reach + 1):
        for dj in range(-reach, reach + 1):
            a, b = i + di, j + dj
            if di * di + dj * dj > radius * radius or not (0 <= a < r.side and 0 <= b < r.side) or (r.brush[a, b] >= 0 and r.brush[a, b] != own):
                continue
            cuts = sorted({0.0, 1.0, *((k + 0.5) / abs(di) for k in range(abs(di))), *((k + 0.5) / abs(dj) for k in range(abs(dj)))})
            cells = {(math.floor(i + 0.5 + di * (f + g) / 2), math.floor(j + 0.5 + dj * (f + g) / 2)) for f, g in zip(cuts, cuts[1:]) if g - f > 1e-9}
            out[di + reach, dj + reach] = not any(stops(*c) for c in cells - {(i, j), (a, b)})
    return out


@pytest.mark.parametrize("radius", [1, 3.5, 9, 15])
def test_open_ground_gives_the_disc(radius):
    assert (view(raster(), 20, 20, radius) == disc(radius)).all()


def test_a_long_wall_hides_what_is_behind_it_and_is_seen_itself():
    got = view(raster(walls=[(23, j) for j in range(40)]), 20, 20, 12)
    want = disc(12)
    want[12 + 4 :] = False
    assert (got == want).all()


def test_nothing_is_seen_off_the_raster():
    got = view(raster(), 0, 39, 6)
    assert got[:6].sum() == 0 and got[:, 7:].sum() == 0 and got[6:, :7].sum() == disc(6)[6:, :7].sum()


def test_brush_from_outside_and_inside():
    patch = [(i, j, 1) for i in (24, 25) for j in range(15, 26)] + [(28, 20, 2)]
    r = raster(brush=patch)
    outside = view(r, 20, 20, 12)
    assert not outside[12 + 4 :, 12].any() and outside[12 + 3, 12]
    inside = view(r, 24, 20, 8)
    assert inside[8 + 1, 8] and inside[8 + 3, 8] and not inside[8 + 4, 8] and inside[8 - 4, 8]
    assert view(r, 20, 20, 12, patch=1)[12 + 4, 12]


def through_corners(reach):
    """Cells to whose middle the segment passes exactly through corners, where it has no width."""
    d = range(-reach, reach + 1)
    return np.array([[math.gcd(a, b) > 0 and a // math.gcd(a, b) % 2 == 1 and b // math.gcd(a, b) % 2 == 1 for b in d] for a in d])


def by_rays(r, i, j, radius, n=6001):
    """Cells that one of many rays from the middle of the source passes through before it is stopped."""
    reach = int(radius)
    own = r.brush[i, j]
    out = np.zeros((2 * reach + 1,) * 2, bool)
    for angle in (np.arange(n) + 0.37) * 2 * np.pi / n:
        u, v = np.cos(angle), np.sin(angle)
        cuts = np.sort(np.concatenate([[0.0], (np.arange(reach + 1) + 0.5) / abs(u), (np.arange(reach + 1) + 0.5) / abs(v)]))
        for f, g in zip(cuts, cuts[1:]):
            a, b = math.floor(i + 0.5 + u * (f + g) / 2), math.floor(j + 0.5 + v * (f + g) / 2)
            if max(abs(a - i), abs(b - j)) > reach or not (0 <= a < r.side and 0 <= b < r.side):
                break
            foreign = r.brush[a, b] >= 0 and r.brush[a, b] != own
            out[a - i + reach, b - j + reach] |= not foreign
            if (a, b) != (i, j) and (r.blocks[a, b] or foreign):
                break
    return out & disc(radius)


def test_sweep_against_segments_and_rays_on_random_and_adversarial_ground():
    rng = np.random.default_rng(5)
    grounds = []
    for k in range(5):
        walls = [tuple(w) for w in rng.integers(0, 40, (60 + 60 * k, 2))]
        brush = [(int(a), int(b), int(p)) for a, b, p in np.column_stack([rng.integers(0, 40, (40, 2)), rng.integers(0, 3, 40)])]
        grounds.append((raster(walls=walls, brush=brush), [tuple(map(int, c)) for c in rng.integers(0, 40, (2, 2))]))
    door = raster(walls=[(20, j) for j in range(40) if j != 20] + [(k, k) for k in range(8, 18)])
    grounds.append((door, [(15, 20), (19, 20), (10, 11), (25, 3)]))
    seen = missed = 0
    for r, sources in grounds:
        for i, j in sources:
            got = view(r, i, j, 11)
            # Never less than what the segment between the middles or any ray shows, and hardly more than the rays.
            assert not (by_segments(r, i, j, 11) & ~got & ~through_corners(11)).any() and not (by_rays(r, i, j, 11) & ~got).any()
            seen, missed = seen + got.sum(), missed + (got & ~by_rays(r, i, j, 11)).sum()
    assert missed < 0.01 * seen


def test_a_view_within_a_radius_is_the_larger_view_and_the_disc():
    rng = np.random.default_rng(6)
    r = raster(walls=[tuple(w) for w in rng.integers(0, 40, (150, 2))])
    for i, j in rng.integers(0, 40, (10, 2)):
        assert (view(r, i, j, 6) == (view(r, i, j, 11)[5:18, 5:18] & disc(6))).all()


def test_components_and_walks():
    on = np.zeros((9, 9), bool)
    for i, j in ((1, 1), (2, 2), (2, 3), (5, 5), (7, 7), (8, 8), (7, 5), (6, 6)):
        on[i, j] = True
    label = components(on)
    assert len(set(label[on])) == 2 and label[1, 1] == label[2, 3] == 10 and label[5, 5] == label[8, 8] == label[7, 5] == 50 and (label[~on] == -1).all()
    open_cells = np.ones((5, 5), bool)
    open_cells[1, 0:4] = False
    far = walk_distances(open_cells, 0, 0)
    # Round the wall, and not across its corner.
    assert far[2, 0] == 8 * STEP + 2 * STEP and far[0, 3] == 3 * STEP and far[1, 0] == -1 and far[2, 3] == far[1, 4] + STEP + STEP
    assert walk_distances(np.ones((4, 4), bool), 0, 0)[3, 3] == 3 * CORNER and (walk_distances(open_cells, 1, 1) == -1).all()


def test_table_look_up_and_union(spark):
    rng = np.random.default_rng(7)
    side, radius = 150, 40.0
    r = raster(side, walls=[tuple(w) for w in rng.integers(0, side, (900, 2))], brush=[(int(a), int(b), 3) for a, b in rng.integers(0, side, (40, 2))])
    cells = [(int(a), int(b)) for a, b in rng.integers(0, side, (30, 2)) if r.open[a, b]]
    table = view_table(r, spark.createDataFrame(cells[:20], "i int, j int"), radius)
    rows = [(1, k % 3, a, b, 3 if k == 7 else None, float(rng.uniform(2, 40)), "x") for k, (a, b) in enumerate(cells)] + [(1, 0, -4, 3, None, 5.0, "x")]
    found = look_up(spark.createDataFrame(rows, "tick int, team int, i int, j int, patch int, r double, words0 string"), table, r, radius)
    live = {(x.i, x.j): x.live for x in found.collect()}
    assert all(live[c] == (k >= 20 or k == 7) for k, c in enumerate(cells) if cells.count(c) == 1)
    got = {t: np.zeros((side, 192), bool) for t in range(3)}
    for x in united(found, ["tick", "team"], radius).collect():
        got[x.team][x.i, 64 * x.word : 64 * x.word + 64] = [x.bits >> k & 1 for k in range(64)]
    for team in range(3):
        want = np.zeros((side + 80, side + 80), bool)
        for _, t, a, b, patch, own, _ in rows[:-1]:
            if t == team:
                want[a : a + 81, b : b + 81] |= view(r, a, b, radius, patch) & (np.add.outer(np.arange(-40, 41) ** 2, np.arange(-40, 41) ** 2) <= own * own)
        assert (got[team][:, :side] == want[40:-40, 40:-40]).all() and not got[team][:, side:].any()
    assert views(spark.createDataFrame([], "i int, j int, patch int"), r, radius).collect() == []
    assert packed(np.ones((1, 3, 81), bool)).shape == (1, 6)


def test_rasters_as_tables(spark):
    rows = [("a", i, j, 10.0 + 20 * i, -5.0 + 20 * j, (i + j) % 3 > 0, i == 2, j == 1 or (i, j) == (4, 4), None) for i in range(6) for j in range(5)] + [("b", None, None, None, None, None, None, None, "bad")]
    cells = spark.createDataFrame(rows, "path string, i int, j int, x double, z double, walkable boolean, blocks_sight boolean, brush boolean, problem string")
    got = {(r.i, r.j): (r.walkable, r.blocks_sight, r.brush) for r in resampled(cells, 0.0, -15.0, 130.0, 13).collect()}
    near = lambda v, low, last: min(max(math.floor((v - low) / 20), 0), last)
    source = {(r[1], r[2]): r[5:8] for r in rows[:-1]}
    assert len(got) == 169 and all(v == source[near(10 * i + 5.0, 0, 5), near(-15 + 10 * j + 5.0, -15, 4)] for (i, j), v in got.items())
    patches = {(r.i, r.j): r.patch for r in brush_patches(cells.filter("path = 'a'"), ["path"], "brush").collect()}
    assert len(patches) == 7 and len(set(patches.values())) == 2 and patches[0, 1] == 1
    r = collected(cells.filter("path = 'a'").withColumn("patch", F.lit(None).cast("int")), 8)
    assert r.open[0, 1] and not r.open[0, 0] and not r.open[7, 7] and r.blocks[7, 7] and r.blocks[2, 1] and not r.blocks[1, 1]
    far = {(x.seed, x.i, x.j): x.distance for x in distances_from(spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 99, 0)], "seed int, i int, j int"), r).collect()}
    assert {k[0] for k in far} == {1} and far[1, 0, 1] == 0.0 and far[1, 0, 2] == 1.0
