"""Copies of the smallest tables with one kind of dirt each."""

import os

import pyarrow as pa
import pyarrow.parquet as pq


def empty(small: str, to: str) -> str:
    """No rows at all."""
    for f in os.listdir(small):
        pq.write_table(pq.read_table(f"{small}/{f}").slice(0, 0), f"{to}/{f}")
    return to


def with_nulls(small: str, to: str) -> str:
    """Each table with rows of nulls only, and with an extra column of a clashing name."""
    for f in os.listdir(small):
        t = pq.read_table(f"{small}/{f}")
        t = t.append_column("piece", pa.array(["x"] * t.num_rows))
        nulls = pa.table({c.name: pa.nulls(3, c.type) for c in t.schema})
        pq.write_table(pa.concat_tables([t, nulls]), f"{to}/{f}")
    return to
