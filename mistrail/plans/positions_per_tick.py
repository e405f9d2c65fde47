"""Problem 3: a position per slot and tick from anchors and the trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistrail.operators.regular_grid import missing_stretches, positions_on_grid
from mistrail.sources.tables import table

MAP_SIDE = 14_760


def on_grid(spark: SparkSession, data_dir: str) -> DataFrame:
    grid = table(spark, data_dir, "hero", "match_id", "slot").distinct().join(table(spark, data_dir, "matches", "match_id", "n_ticks"), "match_id")
    marks = table(spark, data_dir, "attribution", "match_id", "slot", "tick", "x", "z", "valid").filter("valid")
    # An anchor's time must also lie below n_ticks: the grid ends there.
    anchors = table(spark, data_dir, "anchor", "match_id", "slot", "t", "x", "z").filter(
        f"t > 0.000001 AND NOT isnan(t) AND x BETWEEN 0 AND {MAP_SIDE} AND z BETWEEN 0 AND {MAP_SIDE} AND NOT (x = 0 AND z = 0)"
    )
    return positions_on_grid(grid, marks, anchors)


def p3_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return missing_stretches(on_grid(spark, data_dir))


def p3_coverage(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per slot and match: grid times, those with a reading, filled and missing ones."""
    return on_grid(spark, data_dir).groupBy("match_id", "slot").agg(
        F.count(F.lit(1)).alias("n_ticks"),
        F.count_if(F.col("n_readings") > 0).alias("n_read"),
        F.count_if((F.col("n_readings") == 0) & ~F.col("missing")).alias("n_filled"),
        F.count_if("missing").alias("n_missing"),
    )


_COVER = """
WITH g AS (SELECT DISTINCT h.match_id, h.slot, m.n_ticks FROM hero h JOIN matches m USING (match_id)),
c AS (
  SELECT match_id, slot, tick FROM attribution WHERE valid
  UNION SELECT match_id, slot, CAST(floor(t) AS INT) FROM anchor
  WHERE t > 0.000001 AND NOT isnan(t) AND NOT isnan(x) AND NOT isnan(z) AND t < 100000000 AND x BETWEEN 0 AND 14760 AND z BETWEEN 0 AND 14760 AND NOT (x = 0 AND z = 0)
), ticks AS (SELECT match_id, slot, unnest(range(0, n_ticks)) AS tick FROM g),
u AS (SELECT t.* FROM ticks t ANTI JOIN c ON t.match_id = c.match_id AND t.slot = c.slot AND t.tick = c.tick),
i AS (SELECT *, tick - row_number() OVER (PARTITION BY match_id, slot ORDER BY tick) AS island FROM u),
r AS (SELECT match_id, slot, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS n FROM i GROUP BY match_id, slot, island)
"""

QUERIES = {"p3_found": p3_found, "p3_coverage": p3_coverage}
SQL = {
    "p3_found": _COVER + "SELECT match_id, slot, CAST(first_tick AS INT) AS first_tick, CAST(last_tick AS INT) AS last_tick FROM r WHERE n >= 5",
    "p3_coverage": _COVER
    + """SELECT g.match_id, g.slot, CAST(g.n_ticks AS BIGINT) AS n_ticks, CAST(g.n_ticks - coalesce(sum(r.n), 0) AS BIGINT) AS n_read,
  CAST(coalesce(sum(r.n) FILTER (WHERE r.n < 5), 0) AS BIGINT) AS n_filled, CAST(coalesce(sum(r.n) FILTER (WHERE r.n >= 5), 0) AS BIGINT) AS n_missing
FROM g LEFT JOIN r ON g.match_id = r.match_id AND g.slot = r.slot GROUP BY g.match_id, g.slot, g.n_ticks""",
}
