"""Streams over the files of the fog table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistrail.sources.tables import shared_dir, table
from mistrail.streaming.fog_timeline import LATENESS_MS, fog_stream, timed

#: Seconds of a stretch of the stream's counts.
STRETCH_S = 30


def _read(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    rows = table(spark, data_dir, name)
    return spark.readStream.schema(rows.schema).parquet(f"{data_dir}/{name}.parquet" + ("" if len(rows.inputFiles()) > 1 else "*"))


def with_ends(fog: DataFrame, matches: DataFrame) -> DataFrame:
    """The packets of a match with its start and duration, and a row a little past its end that moves the clock on.

    ``fog`` and ``matches`` are streams or tables; the end of a match comes with its row of ``matches``.
    """
    ends = matches.select(
        "match_id", F.lit(None).cast("long").alias("seq"), (F.coalesce("duration", F.lit(0.0)) + STRETCH_S + 2 * LATENESS_MS / 1000).alias("t"), F.lit(None).cast("long").alias("net_id"), F.lit(None).cast("boolean").alias("leaving"), "started_at", "duration"
    )
    return fog.select("match_id", "seq", "t", "net_id", "leaving", "started_at", "duration").unionByName(ends)


def packets(spark: SparkSession, data_dir: str) -> DataFrame:
    known = table(spark, data_dir, "matches", "match_id", "started_at", "duration")
    return with_ends(_read(spark, data_dir, "fog").join(known, "match_id"), _read(spark, data_dir, "matches"))


def finished(stream: DataFrame, name: str) -> DataFrame:
    """What a stream appends until it has read all that is there: a table in the shared folder, deleted with the session."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    stream.writeStream.outputMode("append").trigger(availableNow=True).format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def s_fog_timeline(spark: SparkSession, data_dir: str) -> DataFrame:
    """The alternating transitions of every unit, by the stream."""
    return finished(fog_stream(packets(spark, data_dir)), "fog-timeline")


def s_fog_counts(spark: SparkSession, data_dir: str) -> DataFrame:
    """Distinct fog packets per match and stretch of 30 s, counted by a stream that closes each window with its watermark."""
    # The rows past the ends go through to the counts: a filter on them would be pushed below the watermark that they move.
    rows = timed(packets(spark, data_dir)).dropDuplicatesWithinWatermark(["match_id", "seq"])
    counts = rows.groupBy("match_id", F.window("at", f"{STRETCH_S} seconds").alias("w"), F.floor(F.col("t") / STRETCH_S).cast("int").alias("stretch")).agg(F.count("seq").alias("n_packets"), F.count_if("leaving").alias("n_leaving"))
    # A stretch of a match lies in two windows of the wall's clock.
    return finished(counts.select("match_id", "stretch", "n_packets", "n_leaving"), "fog-counts").groupBy("match_id", "stretch").agg(F.sum("n_packets").alias("n_packets"), F.sum("n_leaving").alias("n_leaving")).filter("n_packets > 0")


QUERIES = {"s_fog_timeline": s_fog_timeline, "s_fog_counts": s_fog_counts}
SQL = {
    "s_fog_timeline": """WITH u AS (SELECT DISTINCT match_id, net_id, t, seq, CAST(leaving AS INT) AS visible FROM fog WHERE leaving IS NOT NULL AND net_id IS NOT NULL AND t IS NOT NULL AND match_id IN (SELECT match_id FROM matches)),
d AS (SELECT * FROM u QUALIFY visible <> coalesce(lag(visible) OVER (PARTITION BY match_id, net_id ORDER BY t, seq), 0)) SELECT match_id, net_id, t, seq, visible FROM d""",
    "s_fog_counts": """SELECT match_id, CAST(floor(t / 30) AS INT) AS stretch, CAST(count(*) AS BIGINT) AS n_packets, CAST(count(*) FILTER (WHERE leaving) AS BIGINT) AS n_leaving
FROM (SELECT DISTINCT match_id, seq, t, leaving FROM fog WHERE t IS NOT NULL) GROUP BY match_id, stretch""",
}
