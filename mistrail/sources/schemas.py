"""Schemas of the tables, and a report on how a DataFrame differs from one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEMAS = {
    "matches": "match_id string, source string, patch string, started_at timestamp_ntz, duration double, n_ticks int, n_packets int",
    "hero": "match_id string, slot int, net_id long, hero_name string, champion string, team int, hero_role string, t double",
    "fog": "match_id string, seq long, t double, net_id long, leaving boolean",
    "replication": "match_id string, seq long, t double, net_id long, primary_index int, secondary_index int, attr_name string, repl_value double, is_float boolean",
    "anchor": "match_id string, slot int, t double, x double, z double, anchor_kind int, target long",
    "attribution": "match_id string, tick int, slot int, x double, z double, valid boolean, speed double",
    "move_order": "match_id string, order_no long, t double, owner int, n_points int, order_residual double, order_margin double",
    "ward_event": "match_id string, net_id long, owner_slot int, team int, kind string, x double, z double, t0 double, t1 double, t1_known int, sight double",
    "raw_shard": "line_id long, match_id string, received_at timestamp_ntz, body string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def schema_report(df: DataFrame, name: str) -> list[str]:
    """What differs from the table's schema; an empty list if nothing does. Never raises."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in schema(name)}
    report = [f"{name}.{c} is missing" for c in want if c not in have]
    report += [f"{name}.{c} is {have[c].simpleString()}, not {want[c].simpleString()}" for c in want if c in have and have[c] != want[c]]
    return report + [f"{name}.{c} isn't known" for c in have if c not in want]


def read_checked(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """A table read with its fixed schema, never an inferred one."""
    return spark.read.schema(schema(name)).parquet(f"{data_dir}/{name}.parquet")
