"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mistrail.plans import belief_exports, belief_queries, export_queries, fog_stream, ground_queries, key_load, packet_log, positions_per_tick, reckoning, resolution, shard_tables, trajectory_quality, vision, ward_fill

_MODULES = [trajectory_quality, positions_per_tick, ward_fill, key_load, shard_tables, packet_log, resolution, vision, belief_queries, belief_exports, export_queries, reckoning, ground_queries, fog_stream]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, text in m.SQL.items()}
