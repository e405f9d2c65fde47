"""Runs of near-identical consecutive events, collapsed into one event each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mistrail.operators.hot_keys import HOT_ROWS, PIECE_ROWS, join_cuts, piece_of, split_hot


def collapse_runs(
    events: DataFrame,
    entity: list[str],
    time: str,
    seq: str,
    value: str,
    tolerance: float,
    coarse: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """One row per maximal run of events of an ``entity`` whose ``value`` stays the same.

    An event continues the run if its value differs by less than ``tolerance`` from the event just before it, in order
    of (``time``, ``seq``). Columns: ``entity``, n_events, first_seq, last_seq, first_t, last_t, duration, first_value,
    last_value. ``value`` is numeric.

    Method. Values are made canonical by single linkage: in order of value, a step of ``tolerance`` or more begins a new
    class, so that two values of one run are always of one class. Within a class, the difference between the row number
    in the entity and the row number in the entity and class is constant just as long as no event of another class comes
    between: this difference names the candidate runs. Two neighbours in a candidate can still differ by ``tolerance`` or
    more where a third value links them; an exact comparison with the event before splits those.

    Entities with more than ``hot_rows`` events are cut along ``time`` into pieces of about ``piece_rows``; runs at the
    edges of neighbouring pieces are joined afterwards.

    Defined results: rows whose value is null or NaN are left out beforehand; rows of an entity with equal time and seq
    are resent rows and count once (the smallest value stands), as do copies of a row without seq; rows without seq or time
    come first; null keys are equal to each other; no rows give no rows. Other columns of ``events`` don't matter, whatever their names.
    """
    keys = [f"k{i}" for i in range(len(entity))]
    df = events.select(
        *[F.col(c).alias(k) for c, k in zip(entity, keys)],
        F.col(time).cast("double").alias("t"),
        F.col(seq).cast("long").alias("s"),
        F.col(value).cast("double").alias("v"),
    ).filter("v IS NOT NULL AND NOT isnan(v)")
    df, cuts = split_hot(df, keys, "t", [keys[entity.index(c)] for c in coarse] if coarse else None, hot_rows, piece_rows)
    if cuts is None:
        within = keys
    else:
        df = join_cuts(df, cuts, keys).withColumn("piece", piece_of(F.col("cuts"), F.col("t"))).withColumn("hot", F.col("cuts").isNotNull()).drop("cuts")
        within = [*keys, "piece"]
    # Sorting compares 64-bit hashes; the keys themselves only where these are equal.
    df = df.withColumn("h", F.xxhash64(*within))
    part = ["h", *within]
    in_time = Window.partitionBy(*part).orderBy("t", "s", "v")
    seen_before = F.lag("s").over(in_time).eqNullSafe(F.col("s")) & F.lag("t").over(in_time).eqNullSafe(F.col("t")) & (F.col("s").isNotNull() | (F.lag("v").over(in_time) == F.col("v")))
    df = df.withColumn("resent", F.coalesce(seen_before, F.lit(False))).filter("NOT resent").drop("resent")
    df = df.withColumn("rn", F.row_number().over(in_time)).withColumn("split", F.coalesce(F.abs(F.col("v") - F.lag("v").over(in_time)) >= tolerance, F.lit(False)).cast("int"))
    df = df.withColumn("splits", F.sum("split").over(in_time.rowsBetween(Window.unboundedPreceding, 0))).drop("split")
    if cuts is not None:
        df = df.withColumn("n_piece", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    in_value = Window.partitionBy(*part).orderBy("v")
    df = df.withColumn("step", F.coalesce(F.col("v") - F.lag("v").over(in_value) >= tolerance, F.lit(False)).cast("int"))
    df = df.withColumn("class", F.sum("step").over(in_value.rowsBetween(Window.unboundedPreceding, 0))).drop("step")
    df = df.withColumn("run", F.col("rn") - F.row_number().over(Window.partitionBy(*part, "class").orderBy("rn")))
    stats = [
        F.count(F.lit(1)).alias("n_events"),
        F.min_by("s", "rn").alias("first_seq"),
        F.max_by("s", "rn").alias("last_seq"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.min_by("v", "rn").alias("first_value"),
        F.max_by("v", "rn").alias("last_value"),
    ]
    names = ["n_events", "first_seq", "last_seq", "first_t", "last_t", "first_value", "last_value"]
    if cuts is None:
        runs = df.groupBy(*part, "class", "run", "splits").agg(*stats)
    else:
        runs = df.groupBy(*part, "hot", "class", "run", "splits").agg(*stats, F.min("rn").alias("rn"), (F.min("rn") == 1).alias("opens"), (F.max("rn") == F.max("n_piece")).alias("closes"))
        edges = runs.filter("hot AND (opens OR closes)")
        across = Window.partitionBy(*keys).orderBy("piece", "rn")
        goes_on = F.lag("closes").over(across) & F.col("opens") & (F.lag("piece").over(across) != F.col("piece")) & (F.abs(F.col("first_value") - F.lag("last_value").over(across)) < tolerance)
        edges = edges.withColumn("new", F.coalesce(~goes_on, F.lit(True)).cast("int")).withColumn("joined", F.sum("new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        place = F.struct("piece", "rn")
        joined = edges.groupBy(*keys, "joined").agg(
            F.sum("n_events").alias("n_events"),
            *[F.min_by(c, place).alias(c) for c in ("first_seq", "first_value")],
            *[F.max_by(c, place).alias(c) for c in ("last_seq", "last_value")],
            F.min("first_t").alias("first_t"),
            F.max("last_t").alias("last_t"),
        )
        runs = runs.filter("NOT hot OR NOT (opens OR closes)").select(*keys, *names).unionByName(joined.select(*keys, *names))
    return runs.select(*[F.col(k).alias(c) for k, c in zip(keys, entity)], *names, (F.col("last_t") - F.col("first_t")).alias("duration"))
