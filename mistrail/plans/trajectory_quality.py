"""Problem 1: implausible positions, speeds and order residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistrail.operators.spikes import flag_readings
from mistrail.sources.tables import table


def readings(spark: SparkSession, data_dir: str) -> DataFrame:
    """Trajectory and orders in one shape; orders without an owner belong to no source."""
    missing = F.lit(None).cast("double")
    trajectory = table(spark, data_dir, "attribution").select(
        F.lit("attribution").alias("src"), "match_id", "slot", F.col("tick").cast("long").alias("row_no"), F.col("tick").cast("double").alias("at"), "x", "z", "speed", missing.alias("residual")
    )
    orders = table(spark, data_dir, "move_order").filter("owner >= 0").select(
        F.lit("move_order").alias("src"), "match_id", F.col("owner").alias("slot"), F.col("order_no").alias("row_no"), F.col("t").alias("at"), missing.alias("x"), missing.alias("z"), missing.alias("speed"), F.col("order_residual").alias("residual")
    )
    return trajectory.unionByName(orders)


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return flag_readings(readings(spark, data_dir))


def p1_flags_per_source(spark: SparkSession, data_dir: str) -> DataFrame:
    """How many readings of each source and field are implausible."""
    return p1_found(spark, data_dir).groupBy("src", "match_id", "slot", "field").agg(F.count(F.lit(1)).alias("n_flagged"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"))


QUERIES = {"p1_found": p1_found, "p1_flags_per_source": p1_flags_per_source}
SQL: dict[str, str] = {}
