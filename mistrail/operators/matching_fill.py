"""Missing values filled from similar records: predictive mean matching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from mistrail.sources.tables import with_checkpoint_dir

#: Groups of more rows are cut along the prediction into pieces of about so many.
PIECE_ROWS = 200_000
#: A record copies from one of so many nearest donors.
NEAREST = 5
#: Rows that the fit over all groups counts for in the fit of one.
POOLED_ROWS = 25.0
RIDGE = 1e-6
#: Groups whose fits are broadcast at most.
BROADCAST_GROUPS = 39
EVERY = "\x00every group"


@dataclass(frozen=True)
class Target:
    """A column to fill: what predicts it, and ``score``, what the predictors predict for a record whose value is known (a
    bounded function of it, so that an infinite value does no harm). ``lacks`` tells which records need filling, where
    that isn't those whose value is null: one that has a value all the same copies that, as its own donor."""

    name: str
    predictors: list[Column]
    score: Column
    value_type: str = "double"
    lacks: Column | None = None


def _moments(k: int) -> list[Column]:
    """Sums from which the normal equations of ``y`` on an intercept and xs[0]..xs[k-1] are built."""
    terms = [F.lit(1.0), *[F.col("xs")[i] for i in range(k)], F.col("y")]
    return [F.sum(terms[i] * terms[j]).alias(f"m_{i}_{j}") for i in range(k + 2) for j in range(i, k + 2)]


def _matrix(row: dict[str, float], k: int) -> np.ndarray:
    m = np.zeros((k + 2, k + 2))
    for i in range(k + 2):
        for j in range(i, k + 2):
            m[i, j] = m[j, i] = row[f"m_{i}_{j}"]
    return m


def _beta(m: np.ndarray) -> list[float]:
    a = m[:-1, :-1]
    return np.linalg.lstsq(a + RIDGE * np.diag(np.diag(a) + 1e-9), m[:-1, -1], rcond=None)[0].tolist()


def _solver(k: int, pooled: dict[str, np.ndarray]):
    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"g": frame["g"], "beta": [_beta(_matrix(row, k) + pooled[row["target"]]) for row in frame.to_dict("records")]})

    return solve


def _in_pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """``rows`` with ``piece``: numbers that rise with (p, h) within a group, 0 for groups of at most ``piece_rows`` rows."""
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > piece_rows)
    most = sizes.agg(F.max("n")).first()[0]
    if not most:
        return rows.withColumn("piece", F.lit(0).cast("long"))
    n = -(-most // piece_rows)
    cuts = rows.join(F.broadcast(sizes.select("g")), "g").groupBy("g").agg(F.percentile_approx("p", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("cuts"))
    below, upto = F.size(F.filter("cuts", lambda c: c < F.col("p"))), F.size(F.filter("cuts", lambda c: c <= F.col("p")))
    # Where a prediction is a cut, its rows are dealt by their hash, over as many pieces as it is cuts.
    share = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * (upto - below)).cast("long")
    piece = F.when(F.col("cuts").isNull(), 0).when(upto == below, 2 * below).otherwise(2 * below + 1 + F.least(share, upto - below - 1))
    return rows.join(F.broadcast(cuts), "g", "left").withColumn("piece", piece.cast("long")).drop("cuts")


def _edges(searched: DataFrame) -> DataFrame:
    """(g, piece, before, after): the NEAREST donors before and after each piece, nearest first."""
    at = Window.partitionBy("g", "piece")
    order, back = ("p", "h", "id"), (F.desc("p"), F.desc("h"), F.desc("id"))
    numbered = searched.filter("donor IS NOT NULL").withColumn("up", F.row_number().over(at.orderBy(*order))).withColumn("down", F.row_number().over(at.orderBy(*back))).filter((F.col("up") <= NEAREST) | (F.col("down") <= NEAREST))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= NEAREST, F.struct(c, "donor")))), lambda x: x["donor"])
    ends = numbered.groupBy("g", "piece").agg(listed("up").alias("head"), F.reverse(listed("down")).alias("tail"))
    pieces = Window.partitionBy("g").orderBy("piece")
    ends = ends.withColumn("to_here", F.slice(F.reverse(F.flatten(F.collect_list("tail").over(pieces.rowsBetween(1 - NEAREST, 0)))), 1, NEAREST))
    ends = ends.withColumn("from_here", F.slice(F.flatten(F.collect_list("head").over(pieces.rowsBetween(0, NEAREST - 1))), 1, NEAREST))
    every = searched.select("g", "piece").distinct().join(ends, ["g", "piece"], "left")
    before = F.last("to_here", True).over(pieces.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("from_here", True).over(pieces.rowsBetween(1, Window.unboundedFollowing))
    return every.select("g", "piece", before.alias("before"), after.alias("after"))


def fill_all(records: DataFrame, key: list[str], group: Column, targets: list[Target], carry: list[str] | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``key``, ``carry``, target, value (as text), filled, donor: a row per record and target.

    ``filled`` marks the values that were copied, ``donor`` is the donor's key as JSON.

    Method: one ridge regression of a target's score on its predictors per group, pooled with that of all groups (sums of
    all targets combine on the map side, one row per target and group is solved); every record gets its prediction. Donors
    and gaps of a group are sorted by prediction (equal ones by hash); a gap looks at the NEAREST donors before and after
    it, and copies the observed value of one of the NEAREST of these, chosen by hash: every donor can be chosen. Groups of
    more than ``piece_rows`` rows are cut at quantiles of the prediction (a value that fills several pieces, by hash), and
    a piece sees the donors at the edges of its neighbours, so that the result doesn't depend on the cuts. Groups without a
    donor search among all groups. The sums and the predictions are checkpointed, so that each input row is read twice.

    Defined results: a null or NaN predictor counts as 0 (give its absence as a predictor where it tells something); a
    null group is a group; if no record has a value, gaps stay null with the mark false; repeated keys are filled row by
    row; no rows give no rows.
    """
    with_checkpoint_dir(records.sparkSession)
    k = max(len(t.predictors) for t in targets)
    number = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    name = F.coalesce(group.cast("string"), F.lit("\x00null"))
    cells = [
        F.struct(
            F.lit(t.name).alias("target"), F.concat(F.lit(f"{t.name}\x01"), name).alias("g"), F.col(t.name).cast(t.value_type).cast("string").alias("value"),
            F.when(F.col(t.name).isNotNull() & ~F.isnan(t.score.cast("double")), t.score.cast("double")).alias("y"),
            F.coalesce(t.lacks, F.lit(False)).alias("gap") if t.lacks is not None else F.col(t.name).isNull().alias("gap"),
            F.array(*[number(p) for p in t.predictors], *[F.lit(0.0)] * (k - len(t.predictors))).alias("xs"),
        )
        for t in targets
    ]
    carried = [*key, *(carry or [])]
    base = records.select(F.to_json(F.struct(*key)).alias("id"), F.struct(*carried).alias("record"), F.inline(F.array(*cells)))
    sums = base.filter("y IS NOT NULL").groupBy("target", "g").agg(*_moments(k)).checkpoint()
    overall = {r["target"]: r for r in sums.groupBy("target").agg(*[F.sum(c).alias(c) for c in sums.columns if c.startswith("m_")], F.count(F.lit(1)).alias("groups")).collect()}
    whole = {t: _matrix(r.asDict(), k) for t, r in overall.items()}
    betas = sums.mapInPandas(_solver(k, {t: m / m[0, 0] * POOLED_ROWS for t, m in whole.items()}), "g string, beta array<double>")
    few_groups = sum(r["groups"] for r in overall.values()) <= BROADCAST_GROUPS
    pooled = F.coalesce(*[F.when(F.col("target") == t, F.array(*[F.lit(b) for b in _beta(m)])) for t, m in whole.items()], F.lit(None).cast("array<double>"))
    prediction = F.aggregate(F.zip_with(F.coalesce("beta", pooled), F.concat(F.array(F.lit(1.0)), "xs"), lambda b, x: b * x), F.lit(0.0), lambda a, b: a + b)
    predicted = (
        base.join(F.broadcast(betas) if few_groups else betas, "g", "left")
        .select("id", "record", "target", "g", "value", "y", "gap", prediction.alias("p"), F.col("beta").isNotNull().alias("own"))
        .checkpoint()
    )

    donors = predicted.filter("y IS NOT NULL").withColumn("donor", F.struct("id", "p", "value"))
    every = F.concat("target", F.lit(f"\x01{EVERY}"))
    searching = F.col("gap") & F.col("value").isNull()
    if not predicted.filter(searching & ~F.col("own")).isEmpty():
        donors = donors.withColumn("g", F.explode(F.array("g", every)))
    kind = donors.schema["donor"].dataType
    gaps = predicted.filter(searching).withColumn("g", F.when(F.col("own"), F.col("g")).otherwise(every)).withColumn("donor", F.lit(None).cast(kind))
    searched = _in_pieces(donors.unionByName(gaps).withColumn("h", F.xxhash64("id", F.lit(17))), piece_rows)
    over = "IGNORE NULLS OVER (PARTITION BY g, piece ORDER BY p, h, id)"
    ranks = range(1, NEAREST + 1)
    sides = searched.withColumns({f"{f}_{n}": F.expr(f"{f}(donor, {n}) {over}") for f in ("lag", "lead") for n in ranks}).filter("donor IS NULL")
    gaps = sides.join(_edges(searched), ["g", "piece"], "left")
    none = F.array().cast(ArrayType(kind))
    side = lambda f, rest: F.slice(F.concat(F.filter(F.array(*[F.col(f"{f}_{n}") for n in ranks]), lambda d: d.isNotNull()), F.coalesce(rest, none)), 1, NEAREST)
    near = F.concat(side("lag", F.col("before")), side("lead", F.col("after")))
    ranked = F.array_sort(F.transform(near, lambda d: F.struct(F.abs(d["p"] - F.col("p")).alias("far"), F.xxhash64(d["id"], F.col("id")).alias("order"), d["id"].alias("id"), d["value"].alias("value"))))
    picked = gaps.withColumn("ranked", F.slice(ranked, 1, NEAREST)).withColumn("pick", F.when(F.size("ranked") > 0, F.element_at("ranked", (F.pmod(F.xxhash64("id", F.lit(5)), F.size("ranked")) + 1).cast("int"))))
    filled = picked.select("record.*", "target", F.col("pick.value").alias("value"), F.col("pick").isNotNull().alias("filled"), F.col("pick.id").alias("donor"))
    rest = predicted.filter(~searching).select("record.*", "target", "value", F.col("gap").alias("filled"), F.when(F.col("gap"), F.col("id")).alias("donor"))
    return rest.unionByName(filled)


def fill_by_matching(records: DataFrame, key: list[str], group: Column, predictors: list[Column], target: str, score: Column, value_type: str = "double", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``key`` and ``target`` with its gaps filled: key, <target>, <target>_filled, <target>_donor. See ``fill_all``."""
    rows = fill_all(records, key, group, [Target(target, predictors, score, value_type)], piece_rows=piece_rows)
    return rows.select(*key, F.col("value").cast(value_type).alias(target), F.col("filled").alias(f"{target}_filled"), F.col("donor").alias(f"{target}_donor"))
