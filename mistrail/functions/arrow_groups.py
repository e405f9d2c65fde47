"""Whole groups out of the sorted Arrow batches of a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new combination of ``keys`` begins; the rows are sorted by them. Nulls are equal."""
    n = table.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for key in keys:
        column = table[key].combine_chunks()
        before, after = column.slice(0, n - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        if column.null_count:
            differs |= before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False)
        new |= differs
    return np.concatenate([[0], np.flatnonzero(new) + 1]) if n else np.zeros(0, int)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 65_536) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that hold only whole groups, with the first row of each group."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut), starts[:-1]
        held, n = table.slice(cut).to_batches(), table.num_rows - cut
        enough = max(rows, 2 * n)
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_starts(table, keys)


def floats(table: pa.Table, name: str) -> np.ndarray:
    """A numeric column as float64 with NaN for nulls."""
    return table[name].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float, copy=False)
