import math
import random

from pyspark.sql import functions as F

from mistrail.operators.matching_fill import Target, fill_all, fill_by_matching
from mistrail.plans.ward_fill import p4_filled, wards

SCHEMA = "id long, kind string, a double, value double, g string, p double"


def run(df):
    return fill_by_matching(df, ["id"], F.col("kind"), [F.col("a")], "value", F.col("value")).collect()


def test_fills_from_the_group_and_near_the_prediction(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(600):
        kind, a = rng.choice(["u", "w"]), rng.random() * 10
        y = (5 * a if kind == "u" else 200 - 3 * a) + rng.gauss(0, 0.5)
        truth[i] = y
        rows.append((i, kind, a, None if i % 6 == 0 else y, "", 0.0))
    got = run(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.id for r in got) == list(range(600))
    observed = {r[3] for r in rows if r[3] is not None}
    filled = [r for r in got if r.value_filled]
    assert {r.id for r in filled} == set(range(0, 600, 6))
    assert all(r.value in observed and r.value_donor for r in filled)
    assert sum(abs(r.value - truth[r.id]) for r in filled) / len(filled) < 2.0
    assert all(r.value == truth[r.id] and r.value_donor is None for r in got if not r.value_filled)


def test_nulls_lone_groups_and_infinite_values(spark):
    rows = [(1, "u", 1.0, 5.0, "", 0.0), (2, "u", None, None, "", 0.0), (3, None, float("nan"), None, "", 0.0), (4, "lone", 2.0, None, "", 0.0), (5, "u", 1.0, 7.0, "", 0.0)]
    got = {r.id: r for r in run(spark.createDataFrame(rows, SCHEMA))}
    assert all(got[i].value in (5.0, 7.0) and got[i].value_filled for i in (2, 3, 4))
    endless = spark.createDataFrame([(1, "u", 1.0, math.inf, "", 0.0), (2, "u", 1.0, None, "", 0.0)], SCHEMA)
    score = F.when(F.col("value") == math.inf, 0.0).otherwise(1 / (1 + F.col("value")))
    filled = fill_by_matching(endless, ["id"], F.col("kind"), [F.col("a")], "value", score).collect()
    assert all(r.value == math.inf for r in filled)


def test_nothing_known_and_empty(spark):
    rows = [(1, "u", 1.0, None, "", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r.value, r.value_filled) for r in run(df)] == [(None, False)]
    assert run(df.limit(0)) == []


def test_every_donor_counts_and_cuts_change_nothing(spark):
    rng = random.Random(5)
    rows = [(i, "u", round(rng.random(), 3) if i % 3 else 0.5, None if i % 10 == 0 else float(i), "", 0.0) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    fill = lambda **k: {r.id: (r.value, r.value_donor) for r in fill_by_matching(df, ["id"], F.col("kind"), [F.col("a")], "value", F.col("a"), **k).collect() if r.value_filled}
    got = fill()
    assert len(got) == 600 and fill(piece_rows=100) == got
    # The prediction follows a, so the donor's a is one of the five nearest of all donors' (a few have the same).
    known, a = [r[2] for r in rows if r[3] is not None], {r[0]: r[2] for r in rows}
    assert all(abs(a[int(v)] - a[i]) <= sorted(abs(k - a[i]) for k in known)[4] + 1e-9 for i, (v, _) in got.items())
    # About 200 gaps lie at 0.5, as 1,800 donors do: many of them are chosen.
    assert len({v for i, (v, _) in got.items() if a[i] == 0.5}) > 100


def test_wards_held_out(spark, tmp_path):
    """A tenth of the known ends is taken away: the filled ones are nearer to the truth than the kind's median is."""
    rows = spark.read.parquet("/root/testdata/sf0.01/ward_event.parquet")
    out = F.pmod(F.xxhash64("match_id", "net_id", F.lit(3)), F.lit(10)) == 0
    truth = {(r.match_id, r.net_id): r for r in wards(spark, "/root/testdata/sf0.01").filter(out & F.col("lasts").isNotNull() & ~F.col("no_t1")).collect()}
    held = rows.withColumn("t1", F.when(~out, F.col("t1")))
    held.write.parquet(str(tmp_path / "ward_event.parquet"))
    spark.read.parquet("/root/testdata/sf0.01/matches.parquet").write.parquet(str(tmp_path / "matches.parquet"))
    got = {(r.match_id, r.net_id): r for r in p4_filled(spark, str(tmp_path)).collect()}
    known = [r for r in wards(spark, str(tmp_path)).collect() if r.lasts is not None and r.lasts != math.inf]
    median = {kind: sorted(r.lasts for r in known if r.kind == kind) for kind in {r.kind for r in known}}
    ends = [(k, r) for k, r in truth.items() if r.lasts != math.inf and got[k].t1 != math.inf and r.kind in median]
    assert len(ends) > 20 and all(got[k].t1_filled and got[k].t1_donor for k in truth)
    error = sum(abs(got[k].t1 - r.t1) for k, r in ends) / len(ends)
    plain = sum(abs(r.t0 + median[r.kind][len(median[r.kind]) // 2] - r.t1) for _, r in ends) / len(ends)
    assert error < 0.8 * plain
    assert sum((got[k].t1 == math.inf) == (r.lasts == math.inf) for k, r in truth.items()) > 0.9 * len(truth)


def test_an_observed_value_of_the_same_record_comes_first(spark):
    df = spark.createDataFrame([(1, "u", 1.0, 5.0, True), (2, "u", 1.0, 7.0, False), (3, "u", 1.0, None, True), (4, "u", 1.0, None, False)], "id long, kind string, a double, value double, lacks boolean")
    got = {r.id: (r.value, r.filled, r.donor) for r in fill_all(df, ["id"], F.col("kind"), [Target("value", [F.col("a")], F.col("value"), lacks=F.col("lacks"))]).collect()}
    assert got[1] == ("5.0", True, '{"id":1}') and got[2] == ("7.0", False, None) and got[3][1] and got[3][0] in ("5.0", "7.0") and got[4] == (None, False, None)
