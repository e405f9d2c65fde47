"""Problem 5: results per net_id although a few net_ids hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistrail.operators.tree_aggregate import count_rows, maximum, minimum, tree_aggregate
from mistrail.operators.visible_time import visible_time
from mistrail.sources.tables import table

SHARE = 0.02


def _heavy(df: DataFrame, src: str) -> DataFrame:
    rows = df.count()
    counts = tree_aggregate(df.select("net_id"), ["net_id"], [count_rows("n_rows")], rows)
    return counts.filter(F.col("net_id").isNotNull() & (F.col("n_rows") >= SHARE * rows)).select(F.lit(src).alias("src"), "net_id")


def p5_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return _heavy(table(spark, data_dir, "fog"), "fog").unionByName(_heavy(table(spark, data_dir, "replication"), "replication"))


def p5_packets_per_unit(spark: SparkSession, data_dir: str) -> DataFrame:
    """Rows, first and last packet of each net_id in both tables."""
    columns = ["net_id", "t", "seq"]
    both = [table(spark, data_dir, n, *columns).withColumn("src", F.lit(n)) for n in ("fog", "replication")]
    parts = [count_rows("n_rows"), minimum("first_t", "t"), maximum("last_t", "t"), minimum("first_seq", "seq"), maximum("last_seq", "seq")]
    return tree_aggregate(both[0].unionByName(both[1]), ["src", "net_id"], parts)


def p5_visible_time(spark: SparkSession, data_dir: str) -> DataFrame:
    return visible_time(table(spark, data_dir, "fog"))


QUERIES = {"p5_found": p5_found, "p5_packets_per_unit": p5_packets_per_unit, "p5_visible_time": p5_visible_time}
SQL = {
    "p5_found": """
SELECT 'fog' AS src, net_id FROM fog GROUP BY net_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM fog)
UNION ALL
SELECT 'replication', net_id FROM replication GROUP BY net_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM replication)""",
    "p5_packets_per_unit": """
SELECT src, net_id, count(*) AS n_rows, min(t) AS first_t, max(t) AS last_t, min(seq) AS first_seq, max(seq) AS last_seq
FROM (SELECT 'fog' AS src, net_id, t, seq FROM fog UNION ALL SELECT 'replication', net_id, t, seq FROM replication) GROUP BY src, net_id""",
    "p5_visible_time": """
WITH d AS (SELECT DISTINCT match_id, net_id, t, seq, leaving FROM fog WHERE leaving IS NOT NULL),
n AS (SELECT *, lead(t) OVER (PARTITION BY match_id, net_id ORDER BY t, seq) - t AS held FROM d)
SELECT net_id, count(*) AS n_packets, count(DISTINCT match_id) AS n_matches, min(t) AS first_t, max(t) AS last_t,
  round(coalesce(sum(held) FILTER (WHERE leaving), 0), 3) AS visible_seconds FROM n GROUP BY net_id""",
}
