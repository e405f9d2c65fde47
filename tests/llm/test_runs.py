import random

from mistrail.llm.runs import collapse_runs

SCHEMA = "m string, id long, t double, seq long, v double, n_events string"


def brute(rows, tolerance):
    """Runs by one pass over each entity."""
    entities = {}
    for m, i, t, s, v, _ in set(rows):
        if v is not None and v == v:
            entities.setdefault((m, i), []).append((t, s, v))
    out = []
    for key, events in entities.items():
        events.sort()
        run = []
        for e in events:
            if run and abs(e[2] - run[-1][2]) >= tolerance:
                out.append((*key, len(run), run[0][1], run[-1][1]))
                run = []
            run.append(e)
        out.append((*key, len(run), run[0][1], run[-1][1]))
    return sorted(out)


def test_equals_brute_force_also_in_pieces(spark):
    rng = random.Random(5)
    rows, seq = [], 0
    for i in (1, 2, 3):
        value = 0.0
        for _ in range(400 if i == 1 else 60):
            if rng.random() < 0.4:
                value = rng.choice([0.0, 1.0, value + 0.006, value - 0.004, 5.0])
            seq += 1
            row = ("m", i, float(rng.randrange(200)), seq, rng.choice([value, value, value, None, float("nan")]) if rng.random() < 0.1 else value, "x")
            rows += [row, row] if rng.random() < 0.1 else [row]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    pick = lambda d: sorted((r.m, r.id, r.n_events, r.first_seq, r.last_seq) for r in d.collect())
    want = brute(rows, 0.01)
    assert pick(collapse_runs(df, ["m", "id"], "t", "seq", "v", 0.01)) == want
    assert pick(collapse_runs(df, ["m", "id"], "t", "seq", "v", 0.01, coarse=["m"], hot_rows=50, piece_rows=40)) == want


def test_a_run_over_several_pieces_is_one(spark):
    rows = [("m", 1, float(t), t, 1.0, "") for t in range(500)]
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA), ["m", "id"], "t", "seq", "v", 0.01, hot_rows=50, piece_rows=40).collect()
    assert [(r.n_events, r.first_seq, r.last_seq, r.duration) for r in got] == [(500, 0, 499, 499.0)]


def test_linked_values_do_not_join_neighbours(spark):
    # 1.000 and 1.012 differ, though 1.006 later links them.
    rows = [("m", 1, 1.0, 1, 1.0, ""), ("m", 1, 2.0, 2, 1.012, ""), ("m", 1, 3.0, 3, 1.006, "")]
    got = collapse_runs(spark.createDataFrame(rows, SCHEMA), ["m", "id"], "t", "seq", "v", 0.01).collect()
    assert sorted((r.first_seq, r.last_seq) for r in got) == [(1, 1), (2, 3)]


def test_nulls_and_empty(spark):
    rows = [(None, None, None, None, 1.0, None), (None, None, None, None, 1.0, None), ("m", 1, 1.0, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.m, r.n_events) for r in collapse_runs(df, ["m", "id"], "t", "seq", "v", 0.01).collect()] == [(None, 1)]
    assert [(r.m, r.n_events) for r in collapse_runs(df, ["m", "id"], "t", "seq", "v", 0.01, hot_rows=1).collect()] == [(None, 1)]
    assert collapse_runs(df.limit(0), ["m", "id"], "t", "seq", "v", 0.01).collect() == []
