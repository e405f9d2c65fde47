"""Problem 2: packets that repeat a state, one event per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistrail.llm.runs import collapse_runs
from mistrail.sources.tables import table

ENTITY = ["src", "match_id", "net_id", "primary_index", "secondary_index"]
TOLERANCE = 0.01


def _packets(spark: SparkSession, data_dir: str) -> DataFrame:
    """Fog and replication packets in one shape; src 0 is fog, whose state is 0 or 1."""
    fog = table(spark, data_dir, "fog").select(
        F.lit(0).cast("tinyint").alias("src"), "match_id", "net_id", F.lit(-1).alias("primary_index"), F.lit(-1).alias("secondary_index"), "t", "seq", F.col("leaving").cast("double").alias("value")
    )
    replication = table(spark, data_dir, "replication").select(F.lit(1).cast("tinyint").alias("src"), "match_id", "net_id", "primary_index", "secondary_index", "t", "seq", F.col("repl_value").alias("value"))
    return fog.unionByName(replication)


def packet_runs(spark: SparkSession, data_dir: str) -> DataFrame:
    runs = collapse_runs(_packets(spark, data_dir), ENTITY, "t", "seq", "value", TOLERANCE, coarse=["match_id"])
    return runs.withColumn("src", F.when(F.col("src") == 0, "fog").otherwise("replication"))


def p2_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return packet_runs(spark, data_dir).filter("n_events >= 2").select(*ENTITY, "first_seq", "last_seq")


def p2_run_lengths(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per kind of packet and attribute: runs, events and seconds they cover."""
    return (
        packet_runs(spark, data_dir)
        .groupBy("src", "primary_index", "secondary_index")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_events").alias("n_events"), F.max("n_events").alias("longest_run"), F.round(F.sum("duration"), 3).alias("seconds"))
    )


_RUNS_SQL = """
WITH packets AS (
  SELECT DISTINCT 'fog' AS src, match_id, net_id, -1 AS primary_index, -1 AS secondary_index, t, seq, CAST(CAST(leaving AS INT) AS DOUBLE) AS value
  FROM fog WHERE leaving IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'replication', match_id, net_id, primary_index, secondary_index, t, seq, repl_value
  FROM replication WHERE repl_value IS NOT NULL AND NOT isnan(repl_value)
), marked AS (
  SELECT *, CASE WHEN abs(value - lag(value) OVER w) < 0.01 THEN 0 ELSE 1 END AS opens
  FROM packets WINDOW w AS (PARTITION BY src, match_id, net_id, primary_index, secondary_index ORDER BY t, seq)
), numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY src, match_id, net_id, primary_index, secondary_index ORDER BY t, seq) AS run FROM marked
), runs AS (
  SELECT src, match_id, net_id, primary_index, secondary_index, arg_min(seq, struct_pack(t := t, seq := seq)) AS first_seq,
    arg_max(seq, struct_pack(t := t, seq := seq)) AS last_seq, count(*) AS n_events, max(t) - min(t) AS duration
  FROM numbered GROUP BY src, match_id, net_id, primary_index, secondary_index, run
)
"""

QUERIES = {"p2_found": p2_found, "p2_run_lengths": p2_run_lengths}
SQL = {
    "p2_found": _RUNS_SQL + "SELECT src, match_id, net_id, primary_index, secondary_index, first_seq, last_seq FROM runs WHERE n_events >= 2",
    "p2_run_lengths": _RUNS_SQL + "SELECT src, primary_index, secondary_index, count(*) AS n_runs, CAST(sum(n_events) AS BIGINT) AS n_events, max(n_events) AS longest_run, round(sum(duration), 3) AS seconds FROM runs GROUP BY ALL",
}
