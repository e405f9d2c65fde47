"""Raw shards as event rows: demultiplexing, the running clock, repaired times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Times at or below this are no times.
LEAST_TIME = 1e-6
_LINE = "struct<meta:struct<match:string>, events:array<map<string,string>>>"


def shard_events(lines: DataFrame) -> DataFrame:
    """(match_id, line_id, event_no, kind, t, payload) per packet; payload is JSON text.

    Lines that are not valid JSON give nothing, resent ones count once, a missing match_id is read from the body.
    """
    once = lines.select("line_id", "match_id", "body").filter(F.expr("try_parse_json(body)").isNotNull()).dropDuplicates(["line_id", "body"])
    parsed = once.withColumn("line", F.from_json("body", _LINE))
    rows = parsed.select(F.coalesce("match_id", "line.meta.match").alias("match_id"), "line_id", F.posexplode("line.events").alias("event_no", "packet"))
    rows = rows.select("match_id", "line_id", "event_no", F.map_keys("packet")[0].alias("kind"), F.map_values("packet")[0].alias("payload"))
    return rows.withColumn("t", F.expr("try_cast(get_json_object(payload, '$.time') AS DOUBLE)")).select("match_id", "line_id", "event_no", "kind", "t", "payload")


def running_clock(events: DataFrame) -> DataFrame:
    """``events`` with ``clock``, the greatest valid time of the match up to each packet (0 before the first)."""
    so_far = Window.partitionBy("match_id").orderBy("line_id", "event_no").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("clock", F.coalesce(F.max(F.when(F.col("t") > LEAST_TIME, F.col("t"))).over(so_far), F.lit(0.0)))


def repaired_times(events: DataFrame) -> DataFrame:
    """``events`` with ``t_own`` (whether the packet has a valid time) and ``t_repaired``.

    A packet without one gets it by linear interpolation between the valid packets before and after it in the stream, by
    its rank; at the ends of the stream, the nearest one's.
    """
    order = Window.partitionBy("match_id").orderBy("line_id", "event_no")
    good = F.when(F.col("t") > LEAST_TIME, F.col("t"))
    ranked = events.withColumn("rank", F.row_number().over(order)).withColumn("good", good).withColumn("good_rank", F.when(good.isNotNull(), F.row_number().over(order)))
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    ends = ranked.select(
        "*", F.last("good", True).over(back).alias("t0"), F.last("good_rank", True).over(back).alias("r0"), F.first("good", True).over(ahead).alias("t1"), F.first("good_rank", True).over(ahead).alias("r1")
    )
    between = F.col("t0") + (F.col("t1") - F.col("t0")) * (F.col("rank") - F.col("r0")) / (F.col("r1") - F.col("r0"))
    repaired = F.when(F.col("good").isNotNull(), F.col("good")).when(F.col("r0").isNull(), F.col("t1")).when(F.col("r1").isNull(), F.col("t0")).otherwise(between)
    return ends.withColumn("t_own", F.col("good").isNotNull()).withColumn("t_repaired", repaired).drop("rank", "good", "good_rank", "t0", "r0", "t1", "r1")
