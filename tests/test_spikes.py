import math

import numpy as np
import pytest

from mistrail.functions.hmm import posteriors
from mistrail.operators.spikes import SpikeModel, flag_positions, flag_readings, flag_residuals, flag_speeds

MODEL = SpikeModel()
SCHEMA = "src string, match_id string, slot int, row_no long, at double, x double, z double, speed double, residual double, extra string"


def walk(n=60, pace=340.0):
    t = np.arange(n, dtype=float)
    return t, 1000 + pace * t % 9000, np.full(n, 5000.0), np.full(n, pace)


def straight(n=40, pace=100.0):
    t = np.arange(n, dtype=float)
    return t, 1000 + pace * t, np.full(n, 5000.0), np.full(n, pace)


def positions(t, x, z, v):
    return np.flatnonzero(flag_positions(t, x, z, v, np.zeros(len(t), int), 1, MODEL)).tolist()


def test_forward_backward_equals_brute_force():
    rng = np.random.default_rng(2)
    transition, prior = np.array(MODEL.transition), np.array(MODEL.prior)
    sizes = [1, 5, 700, 30]
    starts = np.cumsum([0, *sizes[:-1]])
    likelihood = rng.random((sum(sizes), 4)) + 1e-3
    got = posteriors(likelihood, starts, transition, prior)
    for segment in (1, 7, 100):
        assert np.allclose(posteriors(likelihood, starts, transition, prior, lanes=3, segment=segment), got, atol=1e-12)
    for s, n in zip(starts, sizes):
        own = likelihood[s : s + n]
        forward = [prior * own[0] / (prior * own[0]).sum()]
        for t in range(1, n):
            f = (forward[-1] @ transition) * own[t]
            forward.append(f / f.sum())
        back = np.ones(4)
        for t in range(n - 1, -1, -1):
            both = forward[t] * back
            assert np.allclose(got[s + t], both / both.sum(), atol=1e-12)
            back = transition @ (own[t] * back)
            back /= back.sum()


@pytest.mark.parametrize("length", [1, 2, 3])
def test_position_off_the_path_and_back_is_a_spike(length):
    t, x, z, v = straight()
    z[20 : 20 + length] += 4000
    assert positions(t, x, z, v) == list(range(20, 20 + length))


def test_jump_that_is_kept_and_longer_excursion_are_no_spikes():
    t, x, z, v = straight()
    z[20:] += 4000
    assert positions(t, x, z, v) == []
    t, x, z, v = straight()
    z[20:26] += 4000
    assert positions(t, x, z, v) == []


def test_stuck_position_counts_only_while_moving():
    t, x, z, v = straight()
    x[10:16] = x[10]
    assert positions(t, x, z, v) == [11, 12, 13, 14, 15]
    v[10:16] = 0
    assert positions(t, x, z, v) == []
    t, x, z, v = straight()
    x[10:13] = x[10]
    assert positions(t, x, z, v) == []


def test_impossible_positions_and_missing_ones():
    t, x, z, v = straight()
    x[3], z[9], x[12], z[15] = np.inf, -1, np.nan, 14_761
    assert positions(t, x, z, v) == [3, 9, 15]


def test_speeds():
    t = np.arange(60, dtype=float)
    v = 340 + 5 * np.sin(t)
    v[5:8] = 0  # a stop
    v[20:22] = 900  # a spike
    v[30:38] = 500 + t[30:38] / 10  # a longer change
    v[45:50] = v[45]  # stuck
    v[55] = 1300  # impossible
    got = np.flatnonzero(flag_speeds(t, v, np.zeros(60, int), 1, MODEL)).tolist()
    assert got == [20, 21, 46, 47, 48, 49, 55]


def test_residuals_are_judged_by_their_source():
    low = np.array([50, 60, 45, 70, 52, 900, 61, 48, 55, 66, -1, 50.0])
    high = np.array([800, 900, 700, 950, 640, 900, 1010, 800, 760, 30_000, 777, 820.0])
    both = np.concatenate([low, high])
    got = np.flatnonzero(flag_residuals(both, np.repeat([0, 1], 12), 2, MODEL)).tolist()
    assert got == [5, 10, 21]


def test_nulls_duplicates_empty_and_hot_sources(spark):
    t, x, z, v = straight(300, 30.0)
    v = v + np.sin(t)
    z[100:102] += 4000
    rows = [("attribution", "m", 1, int(k), float(k), float(x[k]), float(z[k]), float(v[k]), None, "e") for k in range(300)]
    rows += [rows[7], ("attribution", "m", 1, None, 5.0, 1.0, 1.0, 1.0, None, None), ("attribution", None, None, 1, 1.0, math.inf, 1.0, None, None, None), ("attribution", "m", 2, 1, None, -5.0, 1.0, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {("m", 1, 100, "pos"), ("m", 1, 101, "pos"), (None, None, 1, "pos")}
    as_set = lambda d: {(r.match_id, r.slot, r.row_no, r.field) for r in d.collect()}
    assert as_set(flag_readings(df)) == want
    assert as_set(flag_readings(df, hot_rows=100, piece_rows=60)) == want
    assert flag_readings(df.limit(0)).collect() == []


def test_pieces_of_a_hot_source_are_judged_by_the_whole_source(spark):
    """Slow in one stretch and fast in the others; what is far off for the slow stretch alone is none for the source."""
    t = np.arange(900, dtype=float)
    v = np.where((t >= 300) & (t < 500), 60.0, 340.0) + 3 * np.sin(t)
    x, z = 1000 + np.abs((np.cumsum(v) % 20_000) - 10_000), np.full(900, 5000.0)
    z[400] += 500
    z[700:702] += 4000
    v[420], v[600] = 150.0, 900.0
    residual = np.where((t >= 200) & (t < 420), 20.0, 300.0) * np.exp(0.1 * np.sin(3 * t))
    residual[300], residual[800] = 150.0, 9000.0
    rows = [("attribution", "m", 1, k, float(k), float(x[k]), float(z[k]), float(v[k]), None, "e") for k in range(900)]
    rows += [("move_order", "m", 1, k, float(k), None, None, None, float(residual[k]), "e") for k in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    flags = lambda **k: {(r.src, r.row_no, r.field) for r in flag_readings(df, **k).collect()}
    whole = flags()
    assert {("attribution", 700, "pos"), ("attribution", 600, "speed"), ("move_order", 800, "order_residual")} <= whole and ("attribution", 400, "pos") not in whole
    assert flags(hot_rows=100, piece_rows=150) == whole and flags(hot_rows=100, piece_rows=90) == whole
