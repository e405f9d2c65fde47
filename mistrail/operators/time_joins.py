"""Joins in time: as-of and interval joins by slices of time, so that no key is sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice.
SLICE = 64.0


def as_of(probes: DataFrame, readings: DataFrame, keys: list[str], probe_t: str, reading_t: str, values: dict[str, str], forward: bool = False, slice_s: float = SLICE) -> DataFrame:
    """``probes`` with the values of the last reading of the same ``keys`` at or before ``probe_t``.

    ``values`` gives the new names by columns of ``readings``; ``forward`` takes the first reading at or after instead.
    Rows are partitioned by keys and slice of time; a probe whose slice has no reading before it gets the last one of the
    slices before, from one row per slice and key. A key with a third of all rows is thus spread over its slices.

    Defined results: probes without a time or with a null key have no reading, readings without a time are left out;
    of readings at the same time the one with the greatest values counts; repeated probes each get theirs.
    """
    sign = -1.0 if forward else 1.0
    value = F.struct(*[F.col(c).alias(n) for c, n in values.items()])
    key_cols = [F.col(k) for k in keys]
    left = probes.withColumn("__row", F.struct(*[F.col(c) for c in probes.columns])).select(*key_cols, (F.col(probe_t).cast("double") * sign).alias("__t"), "__row")
    usable = F.col(reading_t).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    right = readings.filter(usable).select(*key_cols, (F.col(reading_t).cast("double") * sign).alias("__t"), value.alias("__value"))
    kind = left.schema["__row"].dataType
    both = left.withColumn("__value", F.lit(None).cast(right.schema["__value"].dataType)).unionByName(right.withColumn("__row", F.lit(None).cast(kind)))
    both = both.withColumn("__slice", F.floor(F.col("__t") / slice_s))
    # At one time readings come before probes.
    inside = Window.partitionBy(*keys, "__slice").orderBy("__t", F.col("__row").isNotNull(), "__value").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("__own", F.last("__value", True).over(inside)).filter("__row IS NOT NULL").drop("__value")
    last = right.withColumn("__slice", F.floor(F.col("__t") / slice_s)).groupBy(*keys, "__slice").agg(F.max(F.struct("__t", "__value")).alias("__last"))
    # Slices with probes only take their place in the chain of slices, too.
    chain = last.unionByName(left.select(*keys, F.floor(F.col("__t") / slice_s).alias("__slice")).distinct().withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType)))
    chain = chain.groupBy(*keys, "__slice").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = chain.select(*keys, "__slice", F.last("__last", True).over(before).alias("__carried"))
    joined = local.join(carried, [*keys, "__slice"], "left").withColumn("__got", F.coalesce("__own", "__carried.__value"))
    return joined.select("__row.*", "__got.*")


def within_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, slice_s: float = SLICE) -> DataFrame:
    """Inner join of points and the closed intervals of the same keys that hold them.

    Intervals are spread over slices of time and joined by equality of keys and slice; the exact bounds are a filter on
    top. The end must be finite. Columns other than ``keys`` must differ between the two.
    """
    spread = intervals.filter(F.col(end) >= F.col(start)).withColumn("__slice", F.explode(F.sequence(F.floor(F.col(start) / slice_s), F.floor(F.col(end) / slice_s))))
    cut = points.withColumn("__slice", F.floor(F.col(t) / slice_s))
    return cut.join(spread, [*keys, "__slice"]).filter(F.col(t).between(F.col(start), F.col(end))).drop("__slice")
