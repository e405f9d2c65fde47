"""Rasters of ground: resampled, patches of brush, distances along open cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistrail.functions.ground import Raster, components, walk_distances

#: Cells per side of the largest raster: as many rows at most are sent to the driver and on to the tasks.
MOST_SIDE = 512


def resampled(cells: DataFrame, min_x: float, min_z: float, span: float, side: int) -> DataFrame:
    """(path, i, j, walkable, blocks_sight, brush): the raster of ``side`` cells over ``span`` units from (min_x, min_z), each
    cell with the values of the source cell that holds its middle, or of the nearest one beyond the source's edge.

    ``cells`` are those of ``read_navgrids``. Middles are joined by the whole number of their source cell, an equality join.

    Defined results: rows with a problem are left out; a source without cells gives none; repeated cells: the greatest
    values count.
    """
    good = cells.filter("problem IS NULL").groupBy("path", "i", "j").agg(F.max("x").alias("x"), F.max("z").alias("z"), *[F.max(c).alias(c) for c in ("walkable", "blocks_sight", "brush")])
    # The size of a source cell is the distance of the first and last middles over the cells between them.
    shape = good.groupBy("path").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.max("i").alias("last_i"), F.max("j").alias("last_j"))
    size = F.when(F.col("last_i") > 0, (F.col("x1") - F.col("x0")) / F.col("last_i")).otherwise((F.col("z1") - F.col("z0")) / F.greatest("last_j", F.lit(1)))
    shape = shape.withColumn("size", F.when(size > 0, size).otherwise(F.lit(span)))
    axis = F.sequence(F.lit(0), F.lit(side - 1))
    middles = shape.withColumn("ti", F.explode(axis)).withColumn("tj", F.explode(axis))
    at = lambda k, low, first, last: F.least(F.greatest(F.floor((low + (F.col(k) + 0.5) * (span / side) - (F.col(first) - F.col("size") / 2)) / F.col("size")), F.lit(0)), F.col(last)).cast("int")
    middles = middles.select("path", "ti", "tj", at("ti", min_x, "x0", "last_i").alias("i"), at("tj", min_z, "z0", "last_j").alias("j"))
    return middles.join(good, ["path", "i", "j"]).select("path", F.col("ti").alias("i"), F.col("tj").alias("j"), "walkable", "blocks_sight", "brush")


def brush_patches(cells: DataFrame, keys: list[str], on: str) -> DataFrame:
    """``keys``, i, j, patch of the cells where ``on`` holds; a patch is what is connected over edges and corners, named by
    its least (i * MOST_SIDE + j).

    ``keys`` name a raster: a group is one, of MOST_SIDE cells a side at most. Cells with a null or negative place are left out.
    """
    rows = cells.filter(F.col(on) & F.col("i").between(0, MOST_SIDE - 1) & F.col("j").between(0, MOST_SIDE - 1)).select(*keys, "i", "j").distinct()

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((MOST_SIDE, MOST_SIDE), bool)
        grid[frame["i"], frame["j"]] = True
        return frame.assign(patch=components(grid)[frame["i"], frame["j"]].astype(np.int32))

    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "i int, j int, patch int"])
    return rows.select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).groupBy(*keys).applyInPandas(label, schema)


def collected(cells: DataFrame, side: int) -> Raster:
    """The raster of ``cells`` (i, j, walkable, blocks_sight, patch); cells that aren't given block both. At most
    MOST_SIDE squared rows come to the driver."""
    if side > MOST_SIDE:
        raise ValueError(f"more than {MOST_SIDE} cells a side")
    rows = cells.filter(F.col("i").between(0, side - 1) & F.col("j").between(0, side - 1)).groupBy("i", "j").agg(F.max("walkable").alias("walkable"), F.min("blocks_sight").alias("blocks_sight"), F.max("patch").alias("patch")).toPandas()
    raster = Raster(np.zeros((side, side), bool), np.ones((side, side), bool), np.full((side, side), -1, np.int32))
    i, j = rows["i"].to_numpy(int), rows["j"].to_numpy(int)
    raster.open[i, j] = rows["walkable"].to_numpy(bool)
    raster.blocks[i, j] = rows["blocks_sight"].to_numpy(bool)
    raster.brush[i, j] = rows["patch"].fillna(-1).to_numpy(np.int32)
    return raster


def distances_from(seeds: DataFrame, raster: Raster) -> DataFrame:
    """(seed, i, j, distance): shortest walks from each seed (seed, i, j) to the open cells that it reaches, in cells.

    Seeds are spread over the tasks, each of which holds the raster. A seed that isn't on an open cell reaches nothing.
    """
    side = raster.side

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for seed, i, j in frame.itertuples(index=False):
                far = walk_distances(raster.open, int(i), int(j))
                a, b = np.nonzero(far >= 0)
                yield pd.DataFrame({"seed": seed, "i": a.astype(np.int32), "j": b.astype(np.int32), "distance": far[a, b] / 70.0})

    return seeds.filter(F.col("i").between(0, side - 1) & F.col("j").between(0, side - 1)).select("seed", "i", "j").mapInPandas(walk, "seed int, i int, j int, distance double")
