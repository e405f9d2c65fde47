import gzip
import json
import struct
from dataclasses import dataclass

import pytest

from mistrail.config import content_hash
from mistrail.operators.labels import lifetimes, majority_label
from mistrail.operators.packet_log import repaired_times, running_clock, shard_events
from mistrail.operators.trajectory import ANCHOR, DOWN, ORDER, SPEED, trajectories
from mistrail.sources.artifact import StaleArtifact, read_artifact, write_artifact
from mistrail.sources.navgrid import HEADER, parse, read_navgrids
from mistrail.sources.schemas import SCHEMAS, read_checked, schema_report
from mistrail.sources.shards import read_shards


def test_shards_clock_and_repaired_times(spark, tmp_path):
    events = [{"A": {"time": 2.0}}, {"SpawnMinion": {"time": 1.9e-39}}, {"A": {"time": 6.0}}, {"A": {"time": 5.0}}, {"A": {}}]
    lines = [json.dumps({"meta": {"match": "m"}, "events": events}), '{"events":[', ""]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    packets = shard_events(read_shards(spark, str(tmp_path / "a.jsonl.gz")))
    rows = sorted(running_clock(packets).collect(), key=lambda r: r.event_no)
    assert [(r.match_id, r.kind, r.clock) for r in rows] == [("m", "A", 2.0), ("m", "SpawnMinion", 2.0), ("m", "A", 6.0), ("m", "A", 6.0), ("m", "A", 6.0)]
    fixed = sorted(repaired_times(packets).collect(), key=lambda r: r.event_no)
    assert [(r.t_own, r.t_repaired) for r in fixed] == [(True, 2.0), (False, 4.0), (True, 6.0), (True, 5.0), (False, 5.0)]


def test_schemas(spark, small):
    for name in SCHEMAS:
        assert schema_report(read_checked(spark, small, name), name) == []
        assert schema_report(spark.read.parquet(f"{small}/{name}.parquet"), name) == []
    report = schema_report(spark.range(1).selectExpr("id AS seq", "'x' AS t", "1 AS more"), "fog")
    assert "fog.match_id is missing" in report and "fog.t is string, not double" in report and "fog.more isn't known" in report


@dataclass(frozen=True)
class Spec:
    grid: int = 64
    name: str = "x"


def test_artifact_round_trip_and_staleness(spark, tmp_path):
    df = spark.createDataFrame([("m", 1, 2.5), ("n", None, None)], "match_id string, k int, v double")
    write_artifact({"a": df, "b": spark.range(3).toDF("k")}, str(tmp_path / "out"), Spec())
    back = read_artifact(spark, str(tmp_path / "out"), Spec())
    assert sorted(map(tuple, back["a"].select("match_id", "k", "v").collect())) == [("m", 1, 2.5), ("n", None, None)] and back["b"].count() == 3
    with pytest.raises(StaleArtifact):
        read_artifact(spark, str(tmp_path / "out"), Spec(grid=32))
    spark.range(2).toDF("k").write.mode("overwrite").parquet(str(tmp_path / "out" / "b"))
    with pytest.raises(StaleArtifact):
        read_artifact(spark, str(tmp_path / "out"))
    assert content_hash(Spec()) == content_hash({"name": "x", "grid": 64}) != content_hash(Spec(grid=1))


def test_terrain_files(spark, tmp_path):
    flags = [0x00, 0x02, 0x42, 0x01, 0x00, 0x00]
    content = HEADER.pack(7, 1, 0.0, 0.0, 0.0, 150.0, 0.0, 100.0, 50.0, 3, 2) + bytes(48 * 6) + struct.pack("<6H", *flags)
    (tmp_path / "a.nav").write_bytes(content)
    (tmp_path / "b.nav").write_bytes(content[:-1])
    rows = read_navgrids(spark, str(tmp_path)).collect()
    good = sorted((r.j, r.i, r.walkable, r.blocks_sight, r.brush) for r in rows if r.problem is None)
    assert good == [(0, 0, True, False, False), (0, 1, False, True, False), (0, 2, False, False, False), (1, 0, True, False, True), (1, 1, True, False, False), (1, 2, True, False, False)]
    assert [r.problem for r in rows if r.problem] == ["shorter than its cells"]
    assert parse("x", b"")["problem"].tolist() == ["shorter than its header"]


def test_votes_and_lifetimes(spark):
    votes = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "b", 2), (2, "a", 1), (2, None, 0), (3, "a", 1)], "k long, label string, seq long")
    assert {(r.k, r.label, r.n_votes) for r in majority_label(votes, ["k"], "label", "seq", least=2).collect()} == {(1, "a", 2), (2, "a", 1)}
    seen = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 9.0)], "k long, t double")
    dead = spark.createDataFrame([(1, 4.0), (1, 30.0), (1, 20.0)], "k long, t double")
    assert {tuple(r) for r in lifetimes(seen, dead, ["k"], "t", 55.0).collect()} == {(1, 5.0, 20.0, True), (2, 9.0, 64.0, False)}


def test_trajectories(spark):
    event = "match_id string, slot int, t double, kind int, value double, x double, z double, path array<struct<x:double,z:double>>, tick string"
    way = [(100.0, 0.0), (100.0, 500.0)]
    rows = [
        ("m", 0, 0.0, SPEED, 100.0, None, None, None, ""), ("m", 0, 1.0, ANCHOR, None, 100.0, 0.0, None, ""), ("m", 0, 2.0, ORDER, None, None, None, way, ""),
        ("m", 0, 6.5, DOWN, None, None, None, None, ""), ("m", 0, None, ANCHOR, None, 1.0, 1.0, None, ""), ("m", 0, 3.0, ANCHOR, None, None, 1.0, None, ""), ("n", 0, 1.0, ANCHOR, None, 1.0, 1.0, None, ""),
    ]
    got = trajectories(spark.createDataFrame(rows, event), spark.createDataFrame([("m", 10), ("m", 10), ("o", None)], "match_id string, n_ticks int")).collect()
    assert sorted((r.tick, r.x, r.z) for r in got) == [(2, 100.0, 0.0), (3, 100.0, 100.0), (4, 100.0, 200.0), (5, 100.0, 300.0), (6, 100.0, 400.0)]
