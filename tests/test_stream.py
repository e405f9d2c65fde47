import uuid

import pytest
from pyspark.sql import functions as F

from mistrail.plans import base
from mistrail.plans.fog_stream import with_ends
from mistrail.sources.tables import table
from mistrail.streaming.fog_timeline import fog_stream


def run(spark, parts, tmp_path):
    """The stream's rows over files that arrive one by one."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = f"fog_{uuid.uuid4().hex[:8]}"
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = fog_stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    try:
        query.processAllAvailable()
        query.processAllAvailable()
        state = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
    finally:
        query.stop()
    return {(r.match_id, r.net_id, r.t, r.seq, r.visible) for r in spark.table(name).collect()}, state


def batch(spark, small):
    roster = base.roster(spark, small).select("match_id", "slot", "net_id")
    return {(r.match_id, r.net_id, r.t, r.seq, r.visible) for r in base.fog_transitions(spark, small).join(roster, ["match_id", "slot"]).collect()}, {(r.match_id, r.net_id) for r in roster.collect()}


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_matches_that_arrive_one_after_the_other(spark, data, tmp_path):
    known = table(spark, data, "matches", "match_id", "started_at", "duration").orderBy("started_at").limit(6)
    order = [r.match_id for r in known.collect()]
    rows = with_ends(table(spark, data, "fog").join(known, "match_id"), known)
    # Two files a match, in order of arrival; the row past the end comes with the second one.
    parts = []
    for m in order:
        middle = rows.filter(F.col("match_id") == m).agg(F.percentile_approx("seq", 0.5)).first()[0]
        of = rows.filter(F.col("match_id") == m)
        parts += [of.filter(F.col("seq") <= middle), of.filter(F.col("seq").isNull() | (F.col("seq") > middle))]
    got, state = run(spark, parts, tmp_path)
    want, heroes = batch(spark, data)
    assert {g for g in got if (g[0], g[1]) in heroes} == {w for w in want if w[0] in order}
    assert len({g[0] for g in got}) == len(order)
    # Only the last match is remembered.
    units = table(spark, data, "fog").filter(F.col("match_id") == order[-1]).select("net_id").distinct().count()
    assert state <= units + 1


def test_overlapping_matches_late_and_resent_packets(spark, tmp_path):
    schema = "match_id string, seq long, t double, net_id long, leaving boolean, started_at timestamp_ntz, duration double"
    import datetime

    at = lambda s: datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=s)
    a, b = ("a", at(0), 60.0), ("b", at(20), 60.0)
    row = lambda m, seq, t, on, unit=1: (m[0], seq, t, unit, on, m[1], m[2])
    first = [row(a, 1, 1.0, True), row(a, 2, 9.0, False), row(a, 3, 5.0, False), row(a, 1, 1.0, True), row(a, 4, 12.0, None), (None, 9, 1.0, 1, True, at(0), 60.0), row(a, 5, None, True)]
    second = [row(b, 1, 2.0, True), row(a, 6, 20.0, True), row(a, 7, 15.0, False), row(a, 2, 9.0, False)]
    third = [row(a, 8, 50.0, False), row(b, 2, 30.0, True), row(b, 3, 31.0, False), row(a, 9, 140.0, None, None), row(b, 9, 140.0, None, None)]
    got, state = run(spark, [spark.createDataFrame(p, schema) for p in (first, second, third)], tmp_path)
    assert got == {("a", 1, 1.0, 1, 1), ("a", 1, 5.0, 3, 0), ("a", 1, 20.0, 6, 1), ("a", 1, 50.0, 8, 0), ("b", 1, 2.0, 1, 1), ("b", 1, 31.0, 3, 0)}
    assert state == 0
