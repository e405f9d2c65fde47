"""Keyframed delta and xor codes of quantised series, and their inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 4096
KEYFRAME = 64


def quantised(value, side: float, levels: int = LEVELS):
    """A coordinate as one of ``levels`` steps, rounded half to even and clipped."""
    return F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.rint(value / side * (levels - 1)))).cast("int")


def encode(series: DataFrame, keys: list[str], order: str, value: str, levels: int = LEVELS, keyframe: int = KEYFRAME) -> DataFrame:
    """``series`` with ``frame`` (number of its keyframe), ``delta`` (modulo ``levels``) and ``xor`` against the value before.

    The first value of each frame is kept as it is. Windows are per keys and frame, so that a long series is cut into
    frames of ``keyframe`` steps. Null values are left out.
    """
    df = series.filter(F.col(value).isNotNull()).withColumn("frame", F.floor(F.col(order) / keyframe))
    before = F.lag(value).over(Window.partitionBy(*keys, "frame").orderBy(order))
    return df.withColumn("delta", F.when(before.isNull(), F.col(value)).otherwise(F.pmod(F.col(value) - before, F.lit(levels)))).withColumn("xor", F.coalesce(F.col(value).bitwiseXOR(before), F.col(value)))


def decode(codes: DataFrame, keys: list[str], order: str, levels: int = LEVELS) -> DataFrame:
    """``codes`` with ``from_delta`` and ``from_xor``: running sums, modulo and bitwise, within each frame."""
    so_far = Window.partitionBy(*keys, "frame").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return codes.withColumn("from_delta", F.pmod(F.sum("delta").over(so_far), F.lit(levels)).cast("int")).withColumn("from_xor", F.bit_xor("xor").over(so_far))
