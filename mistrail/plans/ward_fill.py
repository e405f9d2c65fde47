"""Problem 4: wards without an end time or without the mark that it is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistrail.operators.matching_fill import Target, fill_all
from mistrail.sources.tables import table, with_checkpoint_dir

KEY = ["match_id", "net_id"]


def wards(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row per ward from its (resent) rows, with what at least one of them lacks.

    Where resent rows disagree, the largest value given counts. ``lasts`` is the time from t0 to t1.
    """
    t1 = F.when(F.col("t1").isNotNull() & ~F.isnan("t1") & (F.col("t0").isNull() | F.isnan("t0") | (F.col("t1") > F.col("t0"))), F.col("t1"))
    known = F.when(F.col("t1_known").isin(0, 1), F.col("t1_known"))
    rows = table(spark, data_dir, "ward_event", *KEY, "team", "kind", "t0", "t1", "t1_known", "sight").select(
        *KEY, "team", F.lower(F.trim("kind")).alias("kind"), "t0", "sight", t1.alias("t1"), known.alias("t1_known"), t1.isNull().alias("no_t1"), known.isNull().alias("no_known")
    )
    one = rows.groupBy(*KEY).agg(
        F.max("team").alias("team"), F.max(F.nullif("kind", F.lit(""))).alias("kind"), F.max("t0").alias("t0"), F.max("t1").alias("t1"), F.max("t1_known").alias("t1_known"), F.max("sight").alias("sight"),
        F.max("no_t1").alias("no_t1"), F.max("no_known").alias("no_known"),
    )
    duration = table(spark, data_dir, "matches", "match_id", "duration")
    return one.join(duration, "match_id", "left").withColumn("lasts", F.col("t1") - F.col("t0")).withColumn("left", F.col("duration") - F.col("t0"))


def _shrunk(lasts):
    """1 for no time, towards 0 for ever: 75 seconds lie at one half."""
    return F.when(F.col(lasts) == float("inf"), 0.0).otherwise(75.0 / (75.0 + F.col(lasts)))


def fill_wards(spark: SparkSession, data_dir: str) -> DataFrame:
    """KEY, t0, t1, target (lasts or t1_known), value, filled, donor: two rows per ward; t1 is as given.

    A field is a gap if at least one row of the ward lacks it. If another row of the ward gives it, that row is the
    donor; else a ward of the same kind with a nearby prediction is. Of t1 it is the time from t0 that is filled.
    """
    group = F.coalesce("kind", F.concat(F.lit("sight "), F.col("sight").cast("string")))
    shared = [F.col("t0") / 100, F.col("left") / 100, F.coalesce(F.col("sight"), F.lit(900.0)) / 1000, F.col("team")]
    lasts = Target("lasts", [*shared, F.col("t1_known"), F.col("t1_known").isNull().cast("double"), F.col("t1_known") * F.col("left") / 100], _shrunk("lasts"), lacks=F.col("no_t1"))
    endless = (F.col("lasts") == float("inf")).cast("double")
    known = Target("t1_known", [*shared, _shrunk("lasts"), endless, F.col("lasts").isNull().cast("double")], F.col("t1_known"), "int", F.col("no_known"))
    return fill_all(wards(with_checkpoint_dir(spark), data_dir), KEY, group, [lasts, known], ["t0", "t1"])


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    return fill_wards(spark, data_dir).filter("filled").select(*KEY, F.when(F.col("target") == "lasts", "t1").otherwise("t1_known").alias("field"))


def p4_filled(spark: SparkSession, data_dir: str) -> DataFrame:
    """t1 and t1_known of every ward, each with its mark and donor; without t0, t1 is reckoned from 0."""
    of = lambda target, c: F.max(F.when(F.col("target") == target, F.col(c)))
    wide = fill_wards(spark, data_dir).groupBy(*KEY).agg(
        F.max("t0").alias("t0"), F.max("t1").alias("t1"), of("lasts", "value").cast("double").alias("lasts"), of("lasts", "filled").alias("t1_filled"), of("lasts", "donor").alias("t1_donor"),
        of("t1_known", "value").cast("int").alias("t1_known"), of("t1_known", "filled").alias("t1_known_filled"), of("t1_known", "donor").alias("t1_known_donor"),
    )
    return wide.select(*KEY, F.coalesce("t1", F.coalesce("t0", F.lit(0.0)) + F.col("lasts")).alias("t1"), "t1_filled", "t1_donor", "t1_known", "t1_known_filled", "t1_known_donor")


def p4_marks(spark: SparkSession, data_dir: str) -> DataFrame:
    """Of every ward which fields are filled, whether both have a value now, and whether just the filled ones have a donor."""
    donors = (F.col("t1_filled") == F.col("t1_donor").isNotNull()) & (F.col("t1_known_filled") == F.col("t1_known_donor").isNotNull())
    return p4_filled(spark, data_dir).select(*KEY, "t1_filled", "t1_known_filled", (F.col("t1").isNotNull() & F.col("t1_known").isin(0, 1)).alias("complete"), donors.alias("donors"))


QUERIES = {"p4_found": p4_found, "p4_filled": p4_filled, "p4_marks": p4_marks}
SQL = {
    "p4_found": """
SELECT DISTINCT match_id, net_id, 't1' AS field FROM ward_event WHERE t1 IS NULL OR isnan(t1) OR t1 <= t0
UNION ALL
SELECT DISTINCT match_id, net_id, 't1_known' FROM ward_event WHERE t1_known IS NULL OR t1_known NOT IN (0, 1)""",
    "p4_marks": """
SELECT match_id, net_id, bool_or(t1 IS NULL OR isnan(t1) OR t1 <= t0) AS t1_filled, bool_or(t1_known IS NULL OR t1_known NOT IN (0, 1)) AS t1_known_filled, true AS complete, true AS donors
FROM ward_event GROUP BY match_id, net_id""",
}
