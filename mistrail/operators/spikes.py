"""Implausible readings of a source: spikes, stuck values and impossible ones, by a hidden Markov model per source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistrail.functions.arrow_groups import floats, whole_groups
from mistrail.functions.hmm import posteriors
from mistrail.operators.hot_keys import HOT_ROWS, PIECE_ROWS, join_cuts, piece_of, split_hot

NORMAL, SPIKE, STUCK, OUT = range(4)
#: Rows of its neighbours that a piece of a hot source also sees, in units of the order column.
HALO = 96.0
#: The medians of a hot source are exact to so small a share of its rows.
RANK_ERROR = 1e-5
#: What is usual for a hot source, as columns: speed at known positions, speed, its spread, log(residual), its spread.
USUAL = ["u_pace", "u_speed", "u_speed_spread", "u_level", "u_level_spread"]


@dataclass(frozen=True)
class SpikeModel:
    """Bounds and parameters; the defaults are the production ones."""

    map_side: float = 14_760.0
    most_speed: float = 1_200.0
    most_residual: float = 20_900.0
    longest_spike: int = 3
    least_stuck: int = 4
    #: A source moves at most so many times its usual speed; what is farther is out of reach.
    reach: float = 2.2
    #: Least spread of log(speed / usual) and log(residual / usual) that a source is credited with.
    speed_spread: float = 0.06
    residual_spread: float = 0.3
    window: int = 9
    #: A residual of fewer times the usual one is no spike.
    least_times: float = 3.5
    transition: tuple[tuple[float, ...], ...] = (
        (0.980, 0.010, 0.005, 0.005),
        (0.500, 0.470, 0.010, 0.020),
        (0.190, 0.010, 0.790, 0.010),
        (0.490, 0.020, 0.010, 0.480),
    )
    prior: tuple[float, ...] = (0.97, 0.01, 0.01, 0.01)


def _median_of(values: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """Median of each group, NaN for a group without values."""
    keep = np.isfinite(values)
    v, g = values[keep], group[keep]
    order = np.lexsort((v, g))
    v, g = v[order], g[order]
    count = np.bincount(g, minlength=n_groups)
    first = np.cumsum(count) - count
    result = np.full(n_groups, np.nan)
    some = count > 0
    low, high = first[some] + (count[some] - 1) // 2, first[some] + count[some] // 2
    result[some] = (v[low] + v[high]) / 2
    return result


def _given(own: np.ndarray, given: np.ndarray | None) -> np.ndarray:
    """What is given for the whole source, else what was found here."""
    return own if given is None else np.where(np.isnan(given), own, given)


def _runs(flag: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row (exclusive) of each stretch of true rows within a group."""
    if not len(flag):
        return np.zeros(0, int), np.zeros(0, int)
    edge = np.concatenate([[True], group[1:] != group[:-1]])
    opens = flag & (edge | np.concatenate([[True], ~flag[:-1]]))
    closes = flag & np.concatenate([edge[1:] | ~flag[1:], [True]])
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _spread(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, int)
    np.add.at(mark, begin, 1)
    np.add.at(mark, end, -1)
    return np.cumsum(mark[:-1]) > 0


def _local_median(values: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Median over the ``window`` values around each; near an end of the group, over its first or last ones."""
    n = len(values)
    if not n:
        return values
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, n))
    start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    low = np.clip(np.arange(n) - window // 2, start, np.maximum(start, start + size - window))
    at = low[:, None] + np.arange(window)
    return np.nanmedian(np.where(at < (start + size)[:, None], values[np.minimum(at, n - 1)], np.nan), axis=1)


def _emissions(score: np.ndarray, spread: np.ndarray, width: float, same: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Likelihood of each reading in each state: a bell of ``spread`` around the usual for normal readings, anything
    within ``width`` for spikes, equality with the reading before for stuck ones, the hard bounds for the rest."""
    bell = np.exp(-0.5 * np.minimum(score / spread, 30.0) ** 2) / (spread * 2.5066)
    p = np.empty((len(score), 4))
    p[:, NORMAL] = np.where(same, 0.01, 0.99) * bell + 1e-12
    p[:, SPIKE] = np.where(same, 0.01, 0.99) / width
    p[:, STUCK] = np.where(same, 0.99, 1e-5)
    p[:, OUT] = 1e-12
    p[out] = (1e-12, 1e-9, 1e-12, 1.0)
    return p


def _stuck(same: np.ndarray, posterior: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """Stretches that the model holds for stuck (or out of range), of at least ``least`` equal readings with the first."""
    begin, end = _runs(same & (posterior[:, STUCK] + posterior[:, OUT] > 0.5), group)
    long = end - begin >= least - 1
    return _spread(begin[long], end[long], len(same))


def _model(p: np.ndarray, group: np.ndarray, model: SpikeModel) -> np.ndarray:
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    return posteriors(p, starts, np.array(model.transition), np.array(model.prior))


def flag_positions(tick: np.ndarray, x: np.ndarray, z: np.ndarray, speed: np.ndarray, group: np.ndarray, n_groups: int, model: SpikeModel, pace_of: np.ndarray | None = None) -> np.ndarray:
    """Implausible positions. Rows are sorted by group and tick; speed is that of the same row. ``pace_of``: usual speed of
    each group, where its rows aren't all of its source."""
    n = len(tick)
    flagged = np.zeros(n, bool)
    have = np.flatnonzero(~np.isnan(x) & ~np.isnan(z))
    t, x, z, v, g = tick[have], x[have], z[have], speed[have], group[have]
    out = ~((x >= 0) & (x <= model.map_side) & (z >= 0) & (z <= model.map_side))
    with np.errstate(invalid="ignore"):
        moving = np.where((v > 0) & (v <= model.most_speed), v, np.nan)
    usual = _given(_median_of(moving, g, n_groups), pace_of)
    same = np.zeros(len(t), bool)
    same[1:] = (g[1:] == g[:-1]) & (x[1:] == x[:-1]) & (z[1:] == z[:-1])
    same &= v != 0
    # Displacement off the path: between two readings that the source can connect in the time given, but neither with this one.
    inside = np.flatnonzero(~out)
    ti, xi, zi, gi = t[inside], x[inside], z[inside], g[inside]
    pace = np.where(np.isnan(usual), model.most_speed, usual)[gi] * model.reach
    excess = np.zeros(len(inside))
    m = len(inside)
    for back in range(1, model.longest_spike + 1):
        for ahead in range(1, model.longest_spike + 2 - back):
            if m <= back + ahead:
                continue
            k = np.arange(back, m - ahead)
            i, j = k - back, k + ahead
            one = gi[i] == gi[j]
            k, i, j = k[one], i[one], j[one]
            short = ti[j - 1] - ti[i + 1] <= model.longest_spike - 1
            k, i, j = k[short], i[short], j[short]
            far = lambda a, b: np.hypot(xi[a] - xi[b], zi[a] - zi[b]) / (pace[k] * np.maximum(np.abs(ti[b] - ti[a]), 0.5))
            off = np.minimum(far(i, k), far(k, j))
            off[far(i, j) > 1.0] = 0.0
            excess[k] = np.maximum(excess[k], off)
    score = np.zeros(len(t))
    score[inside] = np.log(np.maximum(excess, 1.0))
    p = _emissions(score, np.full(len(t), 0.05), 4.0, same, out)
    post = _model(p, g, model)
    spike = (post[:, SPIKE] + post[:, STUCK] > 0.5) & ~out & (score > 0)
    flagged[have] = out | spike | _stuck(same, post, g, model.least_stuck)
    return flagged


def flag_speeds(tick: np.ndarray, speed: np.ndarray, group: np.ndarray, n_groups: int, model: SpikeModel, usual_of: np.ndarray | None = None, spread_of: np.ndarray | None = None) -> np.ndarray:
    """Implausible speeds; 0 is a stop and never a case."""
    flagged = np.zeros(len(tick), bool)
    have = np.flatnonzero(~np.isnan(speed))
    t, v, g = tick[have], speed[have], group[have]
    out = ~((v >= 0) & (v <= model.most_speed))
    moving = (v > 0) & ~out
    usual = _given(_median_of(np.where(moving, v, np.nan), g, n_groups), usual_of)
    score = np.zeros(len(v))
    at = np.flatnonzero(moving)
    log = np.log(v[at])
    globally = np.abs(log - np.log(usual[g[at]]))
    locally = np.abs(log - _local_median(log, g[at], model.window))
    spread = np.maximum(1.4826 * _given(_median_of(globally, g[at], n_groups), spread_of), model.speed_spread)
    score[at] = np.minimum(globally, locally)
    same = np.zeros(len(v), bool)
    same[1:] = (g[1:] == g[:-1]) & (v[1:] == v[:-1]) & (v[1:] != 0)
    width = np.nan_to_num(spread, nan=model.speed_spread)[g]
    post = _model(_emissions(score, width, 3.0, same, out), g, model)
    off = np.zeros(len(v), bool)
    off[at] = (post[at, SPIKE] + post[at, STUCK] > 0.5) & (score[at] > 4 * width[at])
    # Out-of-range readings in the middle of a spike belong to it.
    begin, end = _runs(off | out, g)
    short = t[np.maximum(end - 1, 0)] - t[begin] < model.longest_spike if len(begin) else np.zeros(0, bool)
    spike = off & _spread(begin[short], end[short], len(v))
    flagged[have] = out | spike | _stuck(same, post, g, model.least_stuck)
    return flagged


def flag_residuals(residual: np.ndarray, group: np.ndarray, n_groups: int, model: SpikeModel, level_of: np.ndarray | None = None, spread_of: np.ndarray | None = None) -> np.ndarray:
    """Implausible order residuals."""
    flagged = np.zeros(len(residual), bool)
    have = np.flatnonzero(~np.isnan(residual))
    v, g = residual[have], group[have]
    out = ~((v >= 0) & (v <= model.most_residual))
    log = np.where(out, np.nan, np.log(np.maximum(np.where(out, 1.0, v), 1e-3)))
    level = _given(_median_of(log, g, n_groups), level_of)[g]
    above = np.nan_to_num(log - level).clip(0)
    spread = np.maximum(1.4826 * _given(_median_of(np.abs(log - level), g, n_groups), spread_of), model.residual_spread)[g]
    same = np.zeros(len(v), bool)
    same[1:] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    post = _model(_emissions(above, np.nan_to_num(spread, nan=model.residual_spread), 6.0, same, out), g, model)
    flagged[have] = out | ((post[:, SPIKE] + post[:, STUCK] > 0.5) & ~out & (above > np.log(model.least_times))) | _stuck(same, post, g, model.least_stuck)
    return flagged


def usual_of_hot(df: DataFrame, keys: list[str], model: SpikeModel) -> DataFrame:
    """``keys`` and USUAL of the sources in ``df``: medians and median deviations over all rows of each, by sketches that
    combine on the map side."""
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    median = lambda c: F.percentile_approx(c, 0.5, int(1 / RANK_ERROR))
    speed = F.when(real("speed") & (F.col("speed") > 0) & (F.col("speed") <= model.most_speed), F.col("speed"))
    level = F.when(real("residual") & (F.col("residual") >= 0) & (F.col("residual") <= model.most_residual), F.log(F.greatest("residual", F.lit(1e-3))))
    rows = df.select(*keys, F.when(real("x") & real("z"), speed).alias("pace"), speed.alias("speed"), level.alias("level"))
    middle = rows.groupBy(*keys).agg(median("pace").alias("u_pace"), median("speed").alias("u_speed"), median("level").alias("u_level"))
    off = join_cuts(rows, middle, keys).select(*keys, F.abs(F.log("speed") - F.log("u_speed")).alias("speed"), F.abs(F.col("level") - F.col("u_level")).alias("level"))
    return join_cuts(middle, off.groupBy(*keys).agg(median("speed").alias("u_speed_spread"), median("level").alias("u_level_spread")), keys)


_OUT = "src string, match_id string, slot int, row_no long, field string"


def flag_readings(readings: DataFrame, model: SpikeModel = SpikeModel(), hot_rows: int = HOT_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(src, match_id, slot, row_no, field), one row per implausible reading.

    ``readings`` has src, match_id, slot, row_no, at (time or tick), x, z, speed, residual; a source is (src, match_id,
    slot) in order of (at, row_no). A source has either positions and speeds or residuals; what it lacks is null.

    Method: each source has a hidden Markov model with the states normal, spike, stuck and out-of-range. Its emissions
    are judged by the source's own normal behaviour (usual speed, usual residual, spread of both), forward-backward
    probabilities name the state of each reading, and hard bounds (impossible values, length of a spike or stuck
    stretch, return to the path) confirm it. Two or three equal readings off the usual level are a spike even if the
    model holds the later ones for stuck.

    Rows are partitioned by source and sorted within the partition; many sources are worked on at once with NumPy.
    Sources with more than ``hot_rows`` rows are cut along ``at`` into pieces that see ``HALO`` of their neighbours, after
    which the model has forgotten where a piece began (what is left of it is below 1e-9); the normal behaviour is that of
    the whole source, whose medians are worked out beforehand (to RANK_ERROR of its rows) and joined to its pieces.

    Defined results: exact duplicates count once; null and NaN readings are no readings and no cases, and what lies
    before and after one counts as successive; infinite ones are cases; rows without ``at`` or row_no are left out;
    null keys form sources of their own; no rows give no rows.
    """
    keys = ["src", "match_id", "slot"]
    columns = ["src", "match_id", "slot", "row_no", "at", "x", "z", "speed", "residual"]
    df = readings.select(*columns).filter("at IS NOT NULL AND NOT isnan(at) AND row_no IS NOT NULL")
    df, cuts = split_hot(df, keys, "at", ["match_id"], hot_rows, piece_rows)
    if cuts is None:
        df = df.withColumn("piece", F.lit(0)).withColumn("own", F.lit(True))
    else:
        hot = join_cuts(df, cuts, keys).filter("cuts IS NOT NULL").drop("cuts")
        df = join_cuts(df, join_cuts(cuts, usual_of_hot(hot, keys, model), keys).checkpoint(), keys)
        mine = piece_of(F.col("cuts"), F.col("at"))
        seen = F.sequence(piece_of(F.col("cuts"), F.col("at") - HALO), piece_of(F.col("cuts"), F.col("at") + HALO))
        df = df.withColumn("mine", mine).withColumn("piece", F.explode(seen)).withColumn("own", F.col("piece") == F.col("mine")).drop("mine", "cuts")
    group = [*keys, "piece"]
    usual = USUAL if cuts is not None else []
    df = df.withColumn("h", F.xxhash64(*group)).repartition(*group).sortWithinPartitions("h", *group, "at", "row_no")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["h", *group]):
            n, n_groups = table.num_rows, len(starts)
            g = np.repeat(np.arange(n_groups), np.diff(np.append(starts, n)))
            at, x, z, speed, residual = (floats(table, c) for c in ("at", "x", "z", "speed", "residual"))
            row = table["row_no"].combine_chunks().to_numpy()
            values = (at, x, z, speed, residual)
            again = np.zeros(n, bool)
            again[1:] = (g[1:] == g[:-1]) & (row[1:] == row[:-1])
            for v in values:
                again[1:] &= (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
            keep = np.flatnonzero(~again)
            g, (at, x, z, speed, residual) = g[keep], (v[keep] for v in values)
            of = {u: floats(table, u)[starts] for u in usual}
            own = table["own"].combine_chunks().to_numpy(zero_copy_only=False)[keep]
            for field, hit in (
                ("pos", flag_positions(at, x, z, speed, g, n_groups, model, of.get("u_pace"))),
                ("speed", flag_speeds(at, speed, g, n_groups, model, of.get("u_speed"), of.get("u_speed_spread"))),
                ("order_residual", flag_residuals(residual, g, n_groups, model, of.get("u_level"), of.get("u_level_spread"))),
            ):
                rows = keep[hit & own]
                if len(rows):
                    out = table.select(["src", "match_id", "slot", "row_no"]).take(pa.array(rows))
                    out = out.set_column(2, "slot", pc.cast(out["slot"], pa.int32())).append_column("field", pa.array([field] * len(rows), pa.string()))
                    yield from out.combine_chunks().to_batches()

    return df.select("h", *group, "own", "row_no", "at", "x", "z", "speed", "residual", *usual).mapInArrow(flag, _OUT).distinct()
