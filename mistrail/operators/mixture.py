"""Clusters of points per key in a fixed number of rounds, all keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 5


def mixtures(points: DataFrame, keys: list[str], x: str, z: str, side: float, grid: int = 3, rounds: int = ROUNDS) -> DataFrame:
    """(keys, component, weight, cx, cz, sigma): k-means of the points of each key, as a Gaussian mixture.

    The grid * grid centres begin at the middles of a regular grid; in each round every point goes to its nearest centre
    (the first of equals) and centres move to the mean of their points; an empty one stays. Sums combine on the map side,
    a key's centres travel as one array, so a key may have any number of points. sigma is the root of half the mean
    squared distance.

    Defined results: points with a null, NaN or infinite coordinate are left out; components without points are not
    given; no points give no rows.
    """
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e300)
    pts = points.filter(good(x) & good(z)).select(*keys, F.col(x).cast("double").alias("px"), F.col(z).cast("double").alias("pz"))
    step = side / grid
    start = F.array(*[F.struct(F.lit(i * grid + j).alias("component"), F.lit((i + 0.5) * step).alias("cx"), F.lit((j + 0.5) * step).alias("cz")) for i in range(grid) for j in range(grid)])
    centres = pts.select(*keys).distinct().withColumn("centres", start)
    d2 = lambda c: (c["cx"] - F.col("px")) * (c["cx"] - F.col("px")) + (c["cz"] - F.col("pz")) * (c["cz"] - F.col("pz"))

    def assigned(centres: DataFrame) -> DataFrame:
        nearest = F.array_min(F.transform("centres", lambda c: F.struct(d2(c).alias("d2"), c["component"].alias("component"))))
        return pts.join(centres, keys).withColumn("near", nearest).select(*keys, "px", "pz", F.col("near.component").alias("component"), F.col("near.d2").alias("d2"))

    for _ in range(rounds - 1):
        moved = assigned(centres).groupBy(*keys, "component").agg(F.avg("px").alias("mx"), F.avg("pz").alias("mz"))
        new = moved.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("component", F.struct("mx", "mz").alias("m")))).alias("new"))
        joined = centres.join(new, keys)
        centres = joined.select(*keys, F.transform("centres", lambda c: F.struct(c["component"].alias("component"), F.coalesce(F.col("new")[c["component"]]["mx"], c["cx"]).alias("cx"), F.coalesce(F.col("new")[c["component"]]["mz"], c["cz"]).alias("cz"))).alias("centres"))
    last = assigned(centres).groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"), F.avg("px").alias("cx"), F.avg("pz").alias("cz"), F.avg(F.col("px") * F.col("px")).alias("xx"), F.avg(F.col("pz") * F.col("pz")).alias("zz"))
    whole = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("whole"))
    spread = F.greatest(F.lit(0.0), (F.col("xx") - F.col("cx") * F.col("cx") + F.col("zz") - F.col("cz") * F.col("cz")) / 2)
    return last.join(whole, keys).select(*keys, "component", (F.col("n") / F.col("whole")).alias("weight"), "cx", "cz", F.sqrt(spread).alias("sigma"))
