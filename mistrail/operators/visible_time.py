"""Seconds that a unit was visible, from partial states that are merged in order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Packets of one leaf span at most so many seconds, and a node merges so many neighbours.
LEAF_SECONDS = 16.0
FAN_IN = 16


def _joined(states: Column) -> Column:
    """One state from an array of states in order of time: what lies between two belongs to the earlier one's end."""
    first = F.element_at(states, 1)
    rest = F.slice(states, F.lit(2), F.greatest(F.size(states) - 1, F.lit(0)))
    return F.aggregate(
        rest,
        first,
        lambda a, b: F.struct(
            a["t0"].alias("t0"),
            F.greatest(a["t1"], b["t1"]).alias("t1"),
            b["on"].alias("on"),
            (a["seconds"] + b["seconds"] + F.when(a["on"], b["t0"] - a["t1"]).otherwise(0.0)).alias("seconds"),
            (a["n"] + b["n"]).alias("n"),
        ),
    )


def levels_for(last_t: float | None) -> int:
    """Rounds after which the slices of a match are one."""
    levels = 1
    while LEAF_SECONDS * FAN_IN**levels <= (last_t or 0.0):
        levels += 1
    return levels


def visible_time(packets: DataFrame, levels: int | None = None) -> DataFrame:
    """(net_id, n_packets, n_matches, first_t, last_t, visible_seconds) per net_id.

    ``packets``: match_id, seq, t, net_id, leaving; in a match the unit is visible from a packet with leaving true to its
    next packet. Leaf: the packets of one unit, match and slice of LEAF_SECONDS; each of ``levels`` rounds (as many as
    the latest packet needs, if not given) joins FAN_IN neighbouring slices in order of time, and the matches of a net_id are merged by sums
    over hashed nodes. A net_id that is in every match is in as many leaves as any other, so no task has most of the work.

    Defined results: resent packets (same match_id, seq, t) count once; packets without t, leaving or net_id are left
    out; after its last packet a unit's visibility is unknown and counts as none; no packets give no rows.
    """
    df = packets.select("match_id", "seq", "t", "net_id", "leaving").filter("t IS NOT NULL AND NOT isnan(t) AND leaving IS NOT NULL AND net_id IS NOT NULL")
    levels = levels or levels_for(df.agg(F.max(F.abs("t"))).first()[0])
    df = df.withColumn("node", F.floor(F.col("t") / LEAF_SECONDS))
    order = Window.partitionBy("net_id", "match_id", "node").orderBy("t", "seq", "leaving")
    again = F.lag("seq").over(order).eqNullSafe(F.col("seq")) & (F.lag("t").over(order) == F.col("t")) & (F.lag("leaving").over(order) == F.col("leaving"))
    df = df.withColumn("again", F.coalesce(again, F.lit(False))).filter("NOT again")
    df = df.withColumn("held", F.when(F.col("leaving"), F.coalesce(F.lead("t").over(order) - F.col("t"), F.lit(0.0))).otherwise(0.0))
    state = F.struct(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max_by("leaving", F.struct("t", "seq", "leaving")).alias("on"), F.sum("held").alias("seconds"), F.count(F.lit(1)).alias("n"))
    states = df.groupBy("net_id", "match_id", "node").agg(state.alias("state"))
    for level in range(levels):
        node = F.floor(F.col("node") / FAN_IN) if level + 1 < levels else F.lit(0).cast("long")
        states = states.groupBy("net_id", "match_id", node.alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), "state"))).alias("states"))
        states = states.select("net_id", "match_id", "node", _joined(F.transform("states", lambda s: s["state"])).alias("state"))
    some = states.groupBy("net_id", F.pmod(F.xxhash64("match_id"), F.lit(64)).alias("node")).agg(
        F.sum("state.n").alias("n"), F.count(F.lit(1)).alias("m"), F.min("state.t0").alias("t0"), F.max("state.t1").alias("t1"), F.sum("state.seconds").alias("s")
    )
    return some.groupBy("net_id").agg(
        F.sum("n").alias("n_packets"), F.sum("m").alias("n_matches"), F.min("t0").alias("first_t"), F.max("t1").alias("last_t"), F.round(F.sum("s"), 3).alias("visible_seconds")
    )
