"""Problem 6: flat tables from the nested packets of raw shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistrail.operators.nested_tables import FlatTable, flat_tables, record_triples, repeated_ancestor
from mistrail.sources.tables import table

ENTRIES = "events[].Replication.net_id_to_replication_datas"
#: The flat tables by name: attribute objects, and packets that give a position.
REPLICATION = FlatTable(ENTRIES + "{}[]", {"primary_index": "primary_index", "secondary_index": "secondary_index", "attr_name": "name", "float_value": "data.Float", "int_value": "data.Int"})
CASTS = FlatTable("events[]", {"owner": "CastSpellAns.caster_net_id", "x": "CastSpellAns.source_position.x", "y": "CastSpellAns.source_position.y", "z": "CastSpellAns.source_position.z"}, ("x", "z"))
CAMPS = FlatTable("events[]", {"owner": "CreateNeutral.net_id", "x": "CreateNeutral.position1.x", "y": "CreateNeutral.position1.y", "z": "CreateNeutral.position1.z"}, ("x", "z"))


def shard_tables(spark: SparkSession, data_dir: str, tables: dict[str, FlatTable]) -> DataFrame:
    """The rows of ``tables`` from all shards; only their paths are parsed."""
    prefixes = [p for t in tables.values() for p in t.prefixes()]
    parsed = record_triples(table(spark, data_dir, "raw_shard", "line_id", "body"), "line_id", "body", [ENTRIES], prefixes)
    return flat_tables(parsed, tables).withColumnRenamed("record_id", "line_id").withColumnRenamed("table", "child").withColumn("event_no", F.expr("try_cast(o0 AS INT)"))


def _number(column: str, kind: str):
    return F.expr(f"try_cast({column} AS {kind})")


def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    rows = shard_tables(spark, data_dir, {"replication": REPLICATION, "source_position": CASTS, "position1": CAMPS})
    entry = F.col("child") == "replication"
    owner = F.when(entry, _number("o1", "BIGINT")).otherwise(F.coalesce(_number("owner", "BIGINT"), F.lit(0)))
    return rows.select("line_id", "event_no", "child", owner.alias("owner_id"), F.when(entry, _number("o2", "INT")).otherwise(0).alias("item_no"))


def p6_replication(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row per attribute object: line, event, net id, place in the net id's array, and what it says."""
    rows = shard_tables(spark, data_dir, {"replication": REPLICATION})
    return rows.select(
        "line_id", "event_no", _number("o1", "BIGINT").alias("net_id"), _number("o2", "INT").alias("item_no"), _number("primary_index", "INT").alias("primary_index"), _number("secondary_index", "INT").alias("secondary_index"), "attr_name",
        F.coalesce(_number("float_value", "DOUBLE"), _number("int_value", "DOUBLE")).alias("repl_value"),
    )


def p6_positions(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row per cast or camp that gives x or z of its position."""
    rows = shard_tables(spark, data_dir, {"source_position": CASTS, "position1": CAMPS})
    return rows.select("line_id", "event_no", "child", F.coalesce(_number("owner", "BIGINT"), F.lit(0)).alias("owner_id"), *[_number(c, "DOUBLE").alias(c) for c in "xyz"])


def p6_paths(spark: SparkSession, data_dir: str) -> DataFrame:
    """Which columns each flat table would have: values and types per path."""
    parsed = record_triples(table(spark, data_dir, "raw_shard", "line_id", "body"), "line_id", "body", [ENTRIES])
    return parsed.groupBy(repeated_ancestor(F.col("path")).alias("ancestor"), "path", "type").agg(F.count(F.lit(1)).alias("n_values"))


_EVENTS = """
WITH lines AS (SELECT DISTINCT line_id, body FROM raw_shard WHERE json_valid(body)),
lists AS (SELECT line_id, json_extract(body, '$.events[*]') AS list FROM lines),
ev AS (SELECT line_id, unnest(range(len(list))) AS event_no, unnest(list) AS e FROM lists),
maps AS (
  SELECT line_id, event_no, CASE WHEN json_type(e, '$.Replication.net_id_to_replication_datas') = 'VARCHAR'
    THEN CAST(json_extract_string(e, '$.Replication.net_id_to_replication_datas') AS JSON) ELSE json_extract(e, '$.Replication.net_id_to_replication_datas') END AS m
  FROM ev WHERE json_type(e, '$.Replication.net_id_to_replication_datas') IN ('VARCHAR', 'OBJECT')
),
keyed AS (SELECT line_id, event_no, m, unnest(json_keys(m)) AS k FROM maps),
entries AS (SELECT line_id, event_no, k, json_extract(m, '$."' || k || '"') AS v FROM keyed),
wrapped AS (SELECT line_id, event_no, k, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END AS items FROM entries),
items AS (SELECT line_id, event_no, k, unnest(range(len(items))) AS item_no, unnest(items) AS i FROM wrapped)
"""
QUERIES = {"p6_found": p6_found, "p6_replication": p6_replication, "p6_positions": p6_positions, "p6_paths": p6_paths}
SQL = {
    "p6_found": _EVENTS
    + """
SELECT line_id, CAST(event_no AS INT) AS event_no, 'replication' AS child, CAST(k AS BIGINT) AS owner_id, CAST(item_no AS INT) AS item_no FROM items WHERE json_type(i) = 'OBJECT'
UNION ALL
SELECT line_id, CAST(event_no AS INT), 'source_position', coalesce(CAST(json_extract_string(e, '$.CastSpellAns.caster_net_id') AS BIGINT), 0), 0 FROM ev
WHERE json_extract_string(e, '$.CastSpellAns.source_position.x') IS NOT NULL OR json_extract_string(e, '$.CastSpellAns.source_position.z') IS NOT NULL
UNION ALL
SELECT line_id, CAST(event_no AS INT), 'position1', coalesce(CAST(json_extract_string(e, '$.CreateNeutral.net_id') AS BIGINT), 0), 0 FROM ev
WHERE json_extract_string(e, '$.CreateNeutral.position1.x') IS NOT NULL OR json_extract_string(e, '$.CreateNeutral.position1.z') IS NOT NULL""",
    "p6_replication": _EVENTS
    + """
SELECT line_id, CAST(event_no AS INT) AS event_no, CAST(k AS BIGINT) AS net_id, CAST(item_no AS INT) AS item_no,
  CAST(json_extract_string(i, '$.primary_index') AS INT) AS primary_index, CAST(json_extract_string(i, '$.secondary_index') AS INT) AS secondary_index,
  json_extract_string(i, '$.name') AS attr_name,
  coalesce(TRY_CAST(json_extract_string(i, '$.data.Float') AS DOUBLE), TRY_CAST(json_extract_string(i, '$.data.Int') AS DOUBLE)) AS repl_value
FROM items WHERE json_type(i) = 'OBJECT'""",
    "p6_positions": _EVENTS
    + """
, both_kinds AS (
  SELECT line_id, event_no, 'source_position' AS child, json_extract_string(e, '$.CastSpellAns.caster_net_id') AS o, json_extract(e, '$.CastSpellAns.source_position') AS p FROM ev
  UNION ALL SELECT line_id, event_no, 'position1', json_extract_string(e, '$.CreateNeutral.net_id'), json_extract(e, '$.CreateNeutral.position1') FROM ev
)
SELECT line_id, CAST(event_no AS INT) AS event_no, child, coalesce(CAST(o AS BIGINT), 0) AS owner_id, TRY_CAST(json_extract_string(p, '$.x') AS DOUBLE) AS x,
  TRY_CAST(json_extract_string(p, '$.y') AS DOUBLE) AS y, TRY_CAST(json_extract_string(p, '$.z') AS DOUBLE) AS z
FROM both_kinds WHERE json_extract_string(p, '$.x') IS NOT NULL OR json_extract_string(p, '$.z') IS NOT NULL""",
}
