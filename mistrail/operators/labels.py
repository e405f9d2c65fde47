"""Labels by vote, and lifetimes from first sightings and deaths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority_label(votes: DataFrame, key: list[str], label: str, order: str, least: int = 5) -> DataFrame:
    """(key, label, n_votes): the label with most votes of each key that has at least ``least``; of equals, the first seen.

    Votes combine on the map side to one row per key and label. Null labels don't vote.
    """
    counts = votes.filter(F.col(label).isNotNull()).groupBy(*key, label).agg(F.count(F.lit(1)).alias("n_votes"), F.min(order).alias("__first"))
    best = counts.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n_votes"), "__first", label)))
    whole = counts.withColumn("__all", F.sum("n_votes").over(Window.partitionBy(*key)))
    enough = whole.filter(F.col("__all") >= least).select(*key).distinct()
    return best.filter("__rn = 1").join(enough, key, "left_semi").select(*key, label, "n_votes")


def lifetimes(sightings: DataFrame, deaths: DataFrame, key: list[str], t: str, lasts: float) -> DataFrame:
    """(key, t0, t1, t1_known): first sighting to first death at or after it, or ``lasts`` later where none is known."""
    first = sightings.groupBy(*key).agg(F.min(t).alias("t0"))
    ends = deaths.join(first, key).filter(F.col(t) >= F.col("t0")).groupBy(*key).agg(F.min(t).alias("__end"))
    joined = first.join(ends, key, "left")
    return joined.select(*key, "t0", F.coalesce("__end", F.col("t0") + lasts).alias("t1"), F.col("__end").isNotNull().alias("t1_known"))
