import random

import pyarrow as pa

from mistrail.plans.vision import _CHAIN, nearest_pairs
from mistrail.operators.time_joins import as_of, within_intervals

PROBES, READINGS = "k long, t double, __x string, tag long", "k long, t double, v double, tag string"


def test_as_of_both_ways_equals_brute_force(spark):
    rng = random.Random(5)
    readings = [(rng.choice([1, 2, None]), rng.choice([None, round(rng.random() * 500, 1)]), rng.random(), "r") for _ in range(120)]
    probes = [(rng.choice([1, 2, 3, None]), rng.choice([None, round(rng.random() * 600 - 50, 1)]), "p", i) for i in range(150)] + [(1, 5.0, "p", 900)] * 2
    left, right = spark.createDataFrame(probes, PROBES), spark.createDataFrame(readings, READINGS)
    for forward in (False, True):
        for size in (64.0, 7.0):
            got = {(r.tag, r.v) for r in as_of(left, right, ["k"], "t", "t", {"v": "v"}, forward, size).collect()}
            want = set()
            for k, t, _, tag in probes:
                fit = [(a, v) for q, a, v, _ in readings if q == k and k is not None and a is not None and t is not None and (a >= t if forward else a <= t)]
                if fit:
                    best = min(a for a, _ in fit) if forward else max(a for a, _ in fit)
                    want.add((tag, max(v for a, v in fit if a == best)))
                else:
                    want.add((tag, None))
            assert got == want
    assert as_of(left, right, ["k"], "t", "t", {"v": "v"}).count() == len(probes)
    assert as_of(left.limit(0), right, ["k"], "t", "t", {"v": "v"}).collect() == []
    assert {r.v for r in as_of(left, right.limit(0), ["k"], "t", "t", {"v": "v"}).collect()} == {None}


def test_intervals_equal_brute_force(spark):
    rng = random.Random(6)
    points = [(rng.choice([1, 2, None]), rng.choice([None, rng.random() * 300])) for _ in range(200)]
    spans = [(rng.choice([1, 2, None]), a, a + rng.choice([-1.0, 0.0, 3.0, 200.0])) for a in (rng.random() * 300 for _ in range(40))]
    got = within_intervals(spark.createDataFrame(points, "k long, t double"), spark.createDataFrame(spans, "k long, a double, b double"), ["k"], "t", "a", "b", 16.0)
    want = sorted((k, t, a, b) for k, t in points for q, a, b in spans if k is not None and t is not None and k == q and a <= t <= b)
    assert sorted(map(tuple, got.select("k", "t", "a", "b").collect())) == want


def test_pairs_of_many_chains_in_one_pass():
    """j4_matched_transitions had a pandas frame for each chain; a batch now holds many, cut anywhere."""
    rows = [("m", 1, 1, 1, 3.0, 3.5), ("m", 1, 1, 1, 4.0, 3.5), ("m", 1, 1, 1, 4.0, 5.0), ("m", 1, 1, 2, 90.0, 91.0), ("m", 1, 2, 1, 3.0, 3.5), ("n", 1, 1, 1, 3.0, 2.0), ("n", 1, 1, 1, 3.0, 4.0)]
    table = pa.table(dict(zip([*_CHAIN, "a", "b"], zip(*rows))))
    want = [("m", 1, 1, 1, 3.0, 3.5, 0.5), ("m", 1, 1, 1, 4.0, 5.0, 1.0), ("m", 1, 1, 2, 90.0, 91.0, 1.0), ("m", 1, 2, 1, 3.0, 3.5, 0.5), ("n", 1, 1, 1, 3.0, 2.0, 1.0)]
    for size in (1, 3, 100):
        got = [tuple(r.values()) for b in nearest_pairs(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert got == want
    assert [*nearest_pairs(iter([]))] == []
