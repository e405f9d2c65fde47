"""Beliefs as they are exported and shown: mixtures, scalars and rasters (K3, K4, K6, K7, L8, L10)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistrail.functions.filtering import LATTICE, BeliefModel
from mistrail.functions.mixing import divergence, fit, raster
from mistrail.operators.belief import Reading
from mistrail.plans import base
from mistrail.plans.belief_queries import BIN, BIN_AREA, believed

#: Gaussians of a belief, rounds of their fit, and the share of the peak from which a bin of the raster is lit.
PARTS, ROUNDS, LIT = 16, 5, 0.1
_MIDDLES = (np.stack(np.divmod(np.arange(LATTICE * LATTICE), LATTICE), 1) + 0.5) * BIN


def with_observer(belief: DataFrame, spark: SparkSession, data_dir: str) -> DataFrame:
    teams = base.roster(spark, data_dir).filter("team IS NOT NULL").select("match_id", "slot", (1 - F.col("team")).alias("observer"))
    return belief.join(teams, ["match_id", "slot"])


def _lists(values: list[np.ndarray], row: np.ndarray, n: int) -> pa.Array:
    """One list for each of n rows, null for those that aren't in ``row``."""
    size, absent = np.zeros(n, np.int64), np.ones(n, bool)
    size[row], absent[row] = [len(v) for v in values], False
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(absent, False))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values) if values else np.zeros(0)))


def _reading(schema: pa.Schema, of: Callable[[np.ndarray, np.ndarray, tuple[np.ndarray, ...]], tuple]) -> Reading:
    """What ``of`` makes of the bins, the probabilities and the mixture of each hidden hero's belief, fitted one by one."""

    def read(asked: np.ndarray, size: np.ndarray, bins: np.ndarray, p: np.ndarray, known: dict[str, np.ndarray]) -> list:
        row, ends = np.flatnonzero(asked & (size > 0)), np.cumsum(size)
        found = [of(bins[at], p[at], fit(_MIDDLES[bins[at]], p[at], PARTS, ROUNDS)) for at in (slice(ends[k] - size[k], ends[k]) for k in row)]
        columns = [*zip(*found)] or [()] * len(schema)
        return [_lists([*c], row, len(size)).cast(f.type) if pa.types.is_list(f.type) else pa.array(np.bincount(row, c, len(size)), mask=np.bincount(row, minlength=len(size)) == 0) for f, c in zip(schema, columns)]

    return Reading(schema, read)


def _rastered(mixture: tuple[np.ndarray, ...]) -> np.ndarray:
    return raster(*mixture, _MIDDLES, BIN / 2)


def _lit(bins: np.ndarray, p: np.ndarray, mixture: tuple[np.ndarray, ...]) -> tuple:
    q = _rastered(mixture)
    q = q / q.max()
    bright = np.flatnonzero(q >= LIT)
    return bright, q[bright]


_LIST = pa.list_(pa.float64())
#: Each hidden hero's belief as PARTS Gaussians.
MIXTURES = _reading(pa.schema({c: _LIST for c in ("weight", "cx", "cz", "sigma")}), lambda bins, p, m: (m[0], m[1][:, 0], m[1][:, 1], m[2]))
#: The divergence of the belief from the raster of the mixture.
LOSSES = _reading(pa.schema({"kl": pa.float64()}), lambda bins, p, m: (divergence(np.bincount(bins, p, LATTICE * LATTICE), _rastered(m)),))
#: The bins of that raster, with a peak of 1, that are lit, and how bright they are; bins without belief's ground stay dark.
RASTERS = _reading(pa.schema({"bin": pa.list_(pa.int32()), "v": _LIST}), _lit)


def mixtures_of(spark: SparkSession, data_dir: str, read: Reading) -> DataFrame:
    """(match_id, slot, tick, and the columns of ``read``) of each hidden hero's belief."""
    return believed(spark, data_dir, [BeliefModel()], bins=False, read=read).filter("alive AND NOT seen").select("match_id", "slot", "tick", *read.schema.names)


def k3_belief_mixtures(spark: SparkSession, data_dir: str) -> DataFrame:
    """The belief in each hidden hero at every tick as a mixture of Gaussians."""
    return mixtures_of(spark, data_dir, MIXTURES)


def k7_belief_mixture_fit(spark: SparkSession, data_dir: str) -> DataFrame:
    """What the mixtures lose of the beliefs, per match."""
    return mixtures_of(spark, data_dir, LOSSES).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("kl"), 5).alias("mean_kl"), F.round(F.max("kl"), 5).alias("largest_kl"))


def k6_belief_scalars(spark: SparkSession, data_dir: str) -> DataFrame:
    """Entropy and area of the belief in each hero by slot, at every tick, and by how much more team 1 is in the dark."""
    rows = with_observer(believed(spark, data_dir, [BeliefModel()], bins=False), spark, data_dir)
    pair = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", F.round(c, 4))))).alias(c)
    of = lambda team: F.sum(F.when(F.col("observer") == team, F.col("entropy")).otherwise(0.0))
    return rows.withColumn("area", F.col("area") * BIN_AREA).groupBy("match_id", "tick").agg(F.to_json(pair("entropy")).alias("entropy"), F.to_json(pair("area")).alias("area"), F.round(of(1) - of(0), 4).alias("advantage"))


def l8_belief_rasters(spark: SparkSession, data_dir: str) -> DataFrame:
    """What a viewer shows of a team's beliefs at every tick: the greatest of the rasters of its hidden enemies, and how
    many bins of it are lit."""
    rows = with_observer(mixtures_of(spark, data_dir, RASTERS), spark, data_dir)
    bins = rows.select("match_id", "observer", "tick", F.inline(F.arrays_zip("bin", "v")))
    merged = bins.groupBy("match_id", "observer", "tick", "bin").agg(F.max("v").alias("v"))
    return merged.groupBy("match_id", "observer", "tick").agg(F.count(F.lit(1)).alias("n_lit"), F.round(F.sum("v"), 4).alias("brightness"))


def l10_belief_readouts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Hidden enemies of each team at every tick, and the sums of the entropy and area of what it believes of them."""
    hidden = F.col("alive") & ~F.col("seen")
    of = lambda c: F.round(F.sum(F.when(hidden, c).otherwise(0.0)), 4)
    return with_observer(believed(spark, data_dir, [BeliefModel()], bins=False), spark, data_dir).groupBy("match_id", "observer", "tick").agg(F.count_if(hidden).alias("n_hidden"), of(F.col("entropy")).alias("entropy"), of(F.col("area") * BIN_AREA).alias("area"))


QUERIES = {f.__name__: f for f in (k3_belief_mixtures, k7_belief_mixture_fit, k6_belief_scalars, l8_belief_rasters, l10_belief_readouts)}
SQL: dict[str, str] = {}
