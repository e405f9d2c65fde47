"""Per-key results through a tree of partial states, so that no task receives all partials of a hot key."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one leaf and states that one node of the tree merges.
CHUNK_ROWS = 65_536
FAN_IN = 16


@dataclass(frozen=True)
class Part:
    """One mergeable result: ``leaf`` makes a state from rows, ``merge`` one state from the column of states."""

    name: str
    leaf: Callable[[], Column]
    merge: Callable[[Column], Column]


def count_rows(name: str) -> Part:
    return Part(name, lambda: F.count(F.lit(1)), F.sum)


def minimum(name: str, column: str) -> Part:
    return Part(name, lambda: F.min(column), F.min)


def maximum(name: str, column: str) -> Part:
    return Part(name, lambda: F.max(column), F.max)


def total(name: str, column: str) -> Part:
    return Part(name, lambda: F.sum(column), F.sum)


def chunks_for(rows: int, partitions: int, chunk_rows: int = CHUNK_ROWS) -> tuple[int, int]:
    """Chunks that a partition may have at most, and all in all."""
    per_partition = max(1, math.ceil(rows / chunk_rows))
    return per_partition, per_partition * max(1, partitions)


def rounds_for(chunks: int, fan_in: int = FAN_IN) -> int:
    """Rounds after which one node is left: the logarithm of the number of chunks to the base ``fan_in``."""
    rounds = 1
    while fan_in**rounds < chunks:
        rounds += 1
    return rounds


def tree_aggregate(df: DataFrame, keys: list[str], parts: list[Part], rows: int | None = None, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per combination of ``keys`` with the results of ``parts``.

    The input is cut into chunks of ``chunk_rows`` rows of an input partition as it is read, each chunk is combined locally
    to one state per key, and rounds of merging bring ``fan_in`` neighbouring chunks together at a time until one state per
    key is left. A key that holds a third of all rows sends each task of a round at most ``fan_in`` states of its own.
    ``rows`` sizes the tree (counted if not given); a figure that is too small only lets nodes have more than that.

    Defined results: null keys make a group of their own; nulls in the columns follow the aggregate at hand; no rows
    give no rows. Columns that are not used don't matter.
    """
    per_partition, chunks = chunks_for(df.count() if rows is None else rows, df.rdd.getNumPartitions(), chunk_rows)
    rounds = rounds_for(chunks, fan_in)
    # monotonically_increasing_id holds the input partition above bit 33 and the row in it below.
    place = F.monotonically_increasing_id()
    inside = F.least(F.floor(F.pmod(place, F.lit(1 << 33)) / F.lit(chunk_rows)), F.lit(per_partition - 1))
    chunk = (F.shiftright(place, 33) * F.lit(per_partition) + inside).cast("long")
    states = df.withColumn("__node", chunk).groupBy(*keys, "__node").agg(*[p.leaf().alias(p.name) for p in parts])
    for level in range(rounds):
        up = F.floor(F.col("__node") / F.lit(fan_in)).cast("long")
        merged = [p.merge(F.col(p.name)).alias(p.name) for p in parts]
        states = states.withColumn("__node", up).groupBy(*keys, *(["__node"] if level + 1 < rounds else [])).agg(*merged)
    return states
