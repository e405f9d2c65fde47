"""Pieces of keys that hold more rows than a task should take."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mistrail.sources.tables import with_checkpoint_dir

#: A key with more rows than this is cut into pieces of about PIECE_ROWS rows along its order.
HOT_ROWS = 300_000
PIECE_ROWS = 150_000
#: The cut points of so many hot keys are broadcast (a few KB each); more are joined by shuffle.
BROADCAST_KEYS = 500


def split_hot(df: DataFrame, keys: list[str], order: str, coarse: list[str] | None = None, hot_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """``df`` and the (``keys``, cuts) of the keys with more than ``hot_rows`` rows, or None if there are none.

    ``coarse`` are keys whose groups hold those of ``keys``: as long as none of them is large, one count by them is all
    that is run. Where one is, exact copies of rows are brought to one each beforehand (combining on the map side), so
    that a key isn't hot by its copies alone: callers must count copies once anyhow. The counts combine on the map side,
    so that a hot key costs no more than any other. ``cuts`` are approximate quantiles of ``order``; rows with equal
    ``order`` stay in one piece.
    """
    coarse = coarse or keys
    large = df.groupBy(*coarse).agg(F.count(F.lit(1)).alias("n_coarse")).filter(F.col("n_coarse") > hot_rows)
    most = large.agg(F.max("n_coarse"), F.count(F.lit(1))).first()
    if not most[1]:
        return df, None
    df = df.distinct()
    part = df
    if coarse != keys:
        renamed = large.select(*[F.col(k).alias(f"__{k}") for k in coarse])
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in coarse]
        part = df.join(F.broadcast(renamed) if most[1] <= BROADCAST_KEYS else renamed, on, "left_semi")
    pieces = max(2, math.ceil(most[0] / piece_rows))
    fractions = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    cuts = (
        part.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.percentile_approx(F.col(order).cast("double"), fractions, max(10_000, 20 * pieces)).alias("cuts"))
        .filter(F.col("n_rows") > hot_rows)
        .select(*keys, F.array_distinct("cuts").alias("cuts"))
    )
    with_checkpoint_dir(df.sparkSession)
    cuts = cuts.checkpoint()
    return df, (cuts if cuts.limit(1).count() else None)


def join_cuts(df: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``cuts``, null for keys that aren't hot. Nulls in the keys find their partner."""
    few = cuts.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    renamed = cuts.select(*[F.col(k).alias(f"__cut_{k}") for k in keys], *[c for c in cuts.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__cut_{k}")) for k in keys]
    return df.join(F.broadcast(renamed) if few else renamed, on, "left").drop(*[f"__cut_{k}" for k in keys])


def piece_of(cuts: Column, value: Column) -> Column:
    """Number of the piece in which ``value`` falls; 0 where there are no cuts or no value."""
    return F.coalesce(F.array_size(F.filter(cuts, lambda c: c < value)), F.lit(0))
