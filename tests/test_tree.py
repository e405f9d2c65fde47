import random
from collections import Counter

from mistrail.operators.tree_aggregate import chunks_for, count_rows, maximum, minimum, rounds_for, total, tree_aggregate
from mistrail.operators.visible_time import levels_for, visible_time


def test_equals_plain_counts_for_any_tree(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None, rng.randrange(50)]), rng.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(7)
    want = Counter(k for k, _ in rows)
    for chunk, fan in ((65_536, 16), (20, 2), (7, 3)):
        got = {r.k: r for r in tree_aggregate(df, ["k"], [count_rows("n"), minimum("a", "v"), maximum("b", "v"), total("s", "v")], chunk_rows=chunk, fan_in=fan).collect()}
        assert {k: r.n for k, r in got.items()} == want
        assert all(r.a == min(v for q, v in rows if q == k) and r.b == max(v for q, v in rows if q == k) for k, r in got.items())
    assert tree_aggregate(df.limit(0), ["k"], [count_rows("n")]).collect() == []


def test_rounds_are_logarithmic():
    assert [rounds_for(-(-n // 10), 4) for n in (1, 10, 41, 161, 641)] == [1, 1, 2, 3, 4]
    # Small partitions make chunks of their own.
    assert chunks_for(1000, 50, 65_536) == (1, 50) and chunks_for(0, 0) == (1, 1) and chunks_for(200_000, 3, 65_536) == (4, 12)
    assert [levels_for(t) for t in (None, 0.0, 255.0, 257.0, 16.0 * 16**5)] == [1, 1, 1, 2, 6]


def test_visible_time_in_any_slices(spark):
    rng = random.Random(2)
    packets, seq = [], 0
    for m in ("a", "b", "c"):
        for unit in (1, 2):
            for _ in range(80):
                seq += 1
                packets.append((m, seq, round(rng.random() * 900, 3), unit, rng.choice([True, False, None]), "x"))
    packets += packets[:20] + [("a", 9999, None, 1, True, ""), ("a", 9998, 1.0, None, True, "")]
    got = {r.net_id: r for r in visible_time(spark.createDataFrame(packets, "match_id string, seq long, t double, net_id long, leaving boolean, node string")).collect()}
    for unit in (1, 2):
        seconds = 0.0
        for m in ("a", "b", "c"):
            events = sorted({(t, s, on) for q, s, t, u, on, _ in packets if q == m and u == unit and t is not None and on is not None})
            seconds += sum(b[0] - a[0] for a, b in zip(events, events[1:]) if a[2])
        assert abs(got[unit].visible_seconds - seconds) < 1e-3 and got[unit].n_matches == 3
