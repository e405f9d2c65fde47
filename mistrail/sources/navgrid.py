"""Terrain rasters: binary files with a header, fixed-size cell records and a flag per cell."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Layout of the format (fixed values): version, three corners, cell size and counts, then records and 16-bit flags.
HEADER = struct.Struct("<BH3f3ffII")
RECORD_BYTES, MAX_CELLS = 48, 4_000_000
BRUSH, WALL, SEE_THROUGH = 0x01, 0x02, 0x40
_OUT = "path string, i int, j int, x double, z double, walkable boolean, blocks_sight boolean, brush boolean, problem string"


def parse(path: str, content: bytes) -> pd.DataFrame:
    """One row per cell, or a single row with the problem where the file can't be read."""
    columns = [c.split()[0] for c in _OUT.split(", ")]
    bad = lambda why: pd.DataFrame([[path, None, None, None, None, None, None, None, why]], columns=columns)
    if len(content) < HEADER.size:
        return bad("shorter than its header")
    _, _, min_x, _, min_z, max_x, _, max_z, size, nx, nz = HEADER.unpack_from(content)
    n = nx * nz
    if not 0 < n <= MAX_CELLS or not size > 0 or not (max_x > min_x and max_z > min_z):
        return bad("impossible extent")
    flags_at = HEADER.size + n * RECORD_BYTES
    if len(content) < flags_at + 2 * n:
        return bad("shorter than its cells")
    flags = np.frombuffer(content, "<u2", n, flags_at)
    i, j = np.tile(np.arange(nx), nz), np.repeat(np.arange(nz), nx)
    wall = (flags & WALL) != 0
    return pd.DataFrame(dict(zip(columns, (path, i, j, min_x + (i + 0.5) * size, min_z + (j + 0.5) * size, ~wall, wall & ((flags & SEE_THROUGH) == 0), (flags & BRUSH) != 0, None))))


def read_navgrids(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all terrain files of ``path``; each file is parsed by one task."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                yield parse(name, content)

    return spark.read.format("binaryFile").load(path).select("path", F.col("content")).mapInPandas(cells, _OUT)
