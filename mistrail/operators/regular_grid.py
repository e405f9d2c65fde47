"""Irregular readings onto a regular grid: local linear regression with a compact kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mistrail.functions.arrow_groups import floats, whole_groups
from mistrail.operators.hot_keys import HOT_ROWS

#: Half width of the kernel in ticks; ticks of a stretch whose support decides whether a grid time is missing, and the
#: support that it needs; ticks of one block.
HALF_WIDTH = 5
LEAST_GAP = 5
LEAST_SUPPORT = 1.0
BLOCK = 4096
#: Ticks of its neighbours that a block sees: enough for the kernel and to tell a gap's length at its edge.
HALO = 8
#: Readings of a source are first averaged within so many cells of a tick, so that no tick has an unbounded number.
CELLS = 8

GRID, COVER, READING = 0, 1, 2


def fit_blocks(kind: np.ndarray, t: np.ndarray, x: np.ndarray, z: np.ndarray, weight: np.ndarray, group: np.ndarray, n_groups: int, first: np.ndarray, last: np.ndarray, half_width: int, least_gap: int, least_support: float = LEAST_SUPPORT):
    """Fits of all grid times of several blocks at once.

    Block b has the grid times first[b]..last[b] (inclusive, halo included). Readings of kind COVER lie at the grid time
    t; those of kind READING anywhere in [t, t+1). Returns block, tick, x, z, effective support of the fit and of the
    weakest stretch around it, number of readings in the tick and the mark of a missing one, for each grid time.
    """
    size = np.maximum(last - first + 1, 0)
    base = np.cumsum(size) - size
    total = int(size.sum())
    block = np.repeat(np.arange(n_groups), size)
    tick = np.arange(total) - base[block] + first[block]
    cell = np.floor(t).astype(np.int64)
    inside = (kind != GRID) & (cell >= first[group]) & (cell <= last[group])
    at = base[group[inside]] + cell[inside] - first[group[inside]]
    here = np.bincount(at, weights=weight[inside], minlength=total)
    usable = inside & np.isfinite(x) & np.isfinite(z)
    g, c, tt, xx, zz, w0 = group[usable], cell[usable], t[usable], x[usable], z[usable], weight[usable]
    m = {k: np.zeros(total) for k in ("w", "ww", "d", "dd", "x", "dx", "z", "dz")}
    for offset in range(-half_width, half_width + 1):
        to = c + offset
        d = tt - to
        ok = (to >= first[g]) & (to <= last[g]) & (np.abs(d) < half_width)
        i, d, xo, zo, wo = base[g[ok]] + to[ok] - first[g[ok]], d[ok], xx[ok], zz[ok], w0[ok]
        w = wo * 0.75 * (1 - (d / half_width) ** 2)
        for name, v in (("w", w), ("ww", w * w / wo), ("d", w * d), ("dd", w * d * d), ("x", w * xo), ("dx", w * d * xo), ("z", w * zo), ("dz", w * d * zo)):
            m[name] += np.bincount(i, weights=v, minlength=total)
    with np.errstate(invalid="ignore", divide="ignore"):
        det = m["w"] * m["dd"] - m["d"] ** 2
        steep = det > 1e-6 * m["w"] ** 2
        fit = {}
        for k in "xz":
            fit[k] = np.where(steep, (m["dd"] * m[k] - m["d"] * m["d" + k]) / np.where(steep, det, 1.0), m[k] / m["w"])
        support = np.where(m["w"] > 0, m["w"] ** 2 / m["ww"], 0.0)
    # Support of each stretch of least_gap ticks, by a flat kernel, and of a grid time the least of the stretches that hold
    # it and lie within the grid.
    width = min(least_gap, total)
    stretch = np.zeros(total)
    for ahead in range(width):
        stretch[: total - ahead] += here[ahead:]
    whole = np.zeros(total, bool)
    whole[: total - least_gap + 1] = block[: total - least_gap + 1] == block[least_gap - 1 :] if total >= least_gap else False
    stretch = np.where(whole, stretch, np.inf)
    weakest = np.full(total, np.inf)
    for back in range(width):
        reach = slice(back, total)
        same = block[reach] == block[: total - back]
        weakest[reach] = np.where(same, np.minimum(weakest[reach], stretch[: total - back]), weakest[reach])
    missing = weakest < least_support
    blank = missing | (support == 0)
    return block, tick, np.where(blank, np.nan, fit["x"]), np.where(blank, np.nan, fit["z"]), support, weakest, here, missing


_OUT = "match_id string, slot int, tick int, x double, z double, support double, weakest double, n_readings double, missing boolean"


def positions_on_grid(grid: DataFrame, marks: DataFrame, anchors: DataFrame, half_width: int = HALF_WIDTH, least_gap: int = LEAST_GAP, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(match_id, slot, tick, x, z, support, weakest, n_readings, missing), one row per grid time.

    ``grid``: match_id, slot, n_ticks; the grid of a source is 0..n_ticks-1. ``marks``: match_id, slot, tick, x, z, the
    readings that lie on the grid. ``anchors``: match_id, slot, t, x, z, the irregular ones, each in the tick floor(t).

    Method: at each grid time a line is fitted to the readings within ``half_width`` ticks, weighted by the Epanechnikov
    kernel of their distance in time; its value at the grid time is the position and the Kish sum of the weights its
    effective support. Readings are indexed by tick, so that each is added to the grid times around it and no pairs are
    searched for. Where the support doesn't suffice the grid time is marked as missing: ``weakest`` is the least
    support (by a flat kernel: readings) of any stretch of ``least_gap`` ticks that holds it, infinite where the grid has no such stretch,
    and LEAST_SUPPORT of them are needed. So a stretch without readings is missing from ``least_gap`` ticks on; shorter
    ones are filled from both sides.

    A source is cut into blocks of ``BLOCK`` ticks that also see ``HALO`` ticks of their neighbours, and anchors are
    averaged within an eighth of a tick beforehand (combining on the map side), so that a source with a third of all
    rows spreads over many tasks.

    Defined results: n_ticks null or below 1 gives no grid; sources that are not in ``grid`` give nothing, readings
    outside the grid don't count; a reading with a null, NaN or infinite position covers its tick but isn't used for the
    fit; repeated rows and readings at the same time are averaged; without a usable reading within ``half_width`` x and z
    are null though not missing; null keys never match the grid; extra columns don't matter.
    """
    ends = grid.filter("n_ticks >= 1").groupBy("match_id", "slot").agg(F.max("n_ticks").cast("long").alias("n_ticks")).filter("match_id IS NOT NULL AND slot IS NOT NULL")
    none = F.lit(None).cast("double")
    header = ends.select("match_id", F.col("slot").cast("int").alias("slot"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ticks") - 1) / BLOCK))).alias("block"), F.lit(GRID).cast("tinyint").alias("kind"), F.col("n_ticks").cast("double").alias("t"), none.alias("x"), none.alias("z"), F.lit(1.0).alias("w"))
    on_grid = marks.filter("match_id IS NOT NULL AND slot IS NOT NULL AND tick >= 0").select("match_id", F.col("slot").cast("int").alias("slot"), F.col("tick").cast("double").alias("t"), "x", "z", F.lit(COVER).cast("tinyint").alias("kind"), F.lit(1.0).alias("w"))
    # Copies of a row mustn't fill a block: where a match is that large, they are brought together before the shuffle.
    if on_grid.groupBy("match_id").count().filter(F.col("count") > hot_rows).limit(1).count():
        on_grid = on_grid.groupBy("match_id", "slot", "t", "x", "z", "kind").agg(F.sum("w").alias("w"))
    usable = anchors.filter("match_id IS NOT NULL AND slot IS NOT NULL AND t >= 0 AND t < 1e15").groupBy("match_id", F.col("slot").cast("int").alias("slot"), F.floor(F.col("t") * CELLS).alias("cell"))
    off_grid = usable.agg(F.avg("t").alias("t"), F.avg("x").alias("x"), F.avg("z").alias("z"), F.count(F.lit(1)).cast("double").alias("w"))
    # The mean of times within a cell may be rounded up to its end.
    off_grid = off_grid.select("match_id", "slot", F.least("t", (F.col("cell") + 0.999) / CELLS).alias("t"), "x", "z", F.lit(READING).cast("tinyint").alias("kind"), "w")
    tick, b = F.floor("t"), F.floor(F.floor("t") / BLOCK)
    beside = F.when((tick % BLOCK < HALO) & (tick >= BLOCK), F.array(b - 1, b)).when(tick % BLOCK >= BLOCK - HALO, F.array(b, b + 1)).otherwise(F.array(b))
    shape = ["match_id", "slot", "block", "kind", "t", "x", "z", "w"]
    rows = on_grid.unionByName(off_grid).withColumn("block", F.explode(beside)).select(*shape).unionByName(header.select(*shape))
    group = ["match_id", "slot", "block"]
    rows = rows.withColumn("h", F.xxhash64(*group)).repartition(*group).sortWithinPartitions("h", *group, "kind")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["h", *group]):
            kind = table["kind"].combine_chunks().to_numpy()
            t, x, z, w = (floats(table, c) for c in ("t", "x", "z", "w"))
            number = table["block"].combine_chunks().to_numpy()
            has = kind[starts] == GRID
            n_ticks = np.where(has, t[starts], 0).astype(np.int64)
            begin = number[starts] * BLOCK
            first = np.maximum(begin - HALO, 0)
            last = np.where(has, np.minimum(begin + BLOCK + HALO, n_ticks) - 1, first - 1)
            g = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            block, ticks, fx, fz, support, weakest, here, missing = fit_blocks(kind, t, x, z, w, g, len(starts), first, last, half_width, least_gap)
            own = (ticks >= begin[block]) & (ticks < begin[block] + BLOCK)
            block, ticks, fx, fz, support, weakest, here, missing = (a[own] for a in (block, ticks, fx, fz, support, weakest, here, missing))
            names = table.select(["match_id", "slot"]).take(pa.array(starts)).take(pa.array(block))
            optional = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
            out = pa.table(
                {"match_id": names["match_id"], "slot": names["slot"], "tick": pa.array(ticks.astype(np.int32)), "x": optional(fx), "z": optional(fz), "support": pa.array(support), "weakest": pa.array(weakest), "n_readings": pa.array(here), "missing": pa.array(missing)}
            )
            yield from out.combine_chunks().to_batches(max_chunksize=65_536)

    return rows.mapInArrow(fit, _OUT)


def missing_stretches(on_grid: DataFrame) -> DataFrame:
    """(match_id, slot, first_tick, last_tick) of the maximal stretches of missing grid times.

    Stretches are found per block of ticks and those of one source are joined where they touch: a source sends one row
    per stretch and block to that step.
    """
    block = F.floor(F.col("tick") / BLOCK)
    gone = on_grid.filter("missing").select("match_id", "slot", "tick", block.alias("block"))
    in_block = Window.partitionBy("match_id", "slot", "block").orderBy("tick")
    parts = gone.withColumn("island", F.col("tick") - F.row_number().over(in_block)).groupBy("match_id", "slot", "block", "island").agg(F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))
    source = Window.partitionBy("match_id", "slot").orderBy("first_tick")
    opens = F.coalesce(F.col("first_tick") > F.lag("last_tick").over(source) + 1, F.lit(True)).cast("int")
    joined = parts.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(source.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("match_id", "slot", "stretch").agg(F.min("first_tick").alias("first_tick"), F.max("last_tick").alias("last_tick")).drop("stretch")
