"""Beliefs about where hidden heroes are: particle filters with sightings and their absence as evidence."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from mistrail.functions.filtering import BeliefModel, Filters, Ground, Histogram, Sight
from mistrail.functions.geometry import FOUNTAINS, places_of, world
from mistrail.functions.ground import Raster
from mistrail.functions.scoring import Timeline, densest, entropy_bits, scores

_OUT = pa.schema({
    "model": pa.string(), "match_id": pa.string(), "slot": pa.int32(), "tick": pa.int32(), "alive": pa.bool_(), "seen": pa.bool_(),
    "ess": pa.float64(), "entropy": pa.float64(), "area": pa.int32(), "bins": pa.list_(pa.int32()), "p": pa.list_(pa.float64()),
})
_GROUNDS: dict[tuple[int, float], Ground] = {}


def _ground(raster: Raster, cell: float) -> Ground:
    """The raster made ready, once per Python worker."""
    key = (zlib.crc32(raster.open.tobytes()), cell)
    if key not in _GROUNDS:
        _GROUNDS.clear()
        _GROUNDS[key] = Ground(raster, cell)
    return _GROUNDS[key]


def _seed(match_id: str) -> int:
    return zlib.crc32(str(match_id).encode())


_KEYS = ["match_id", "slot", "tick"]


@dataclass(frozen=True)
class Reading:
    """Columns made of whole beliefs. ``of`` gets, for each row, whether its hero is alive and hidden, and how many bins it
    has; the bins and their probabilities of all rows one after the other; and columns of what is known besides, by name."""

    schema: pa.Schema
    of: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]], list]


def _sorted(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    """Columns of a table as arrays, in the order of its ticks; of numbers, nulls are NaN."""
    order = np.argsort(table["tick"].to_numpy(), kind="stable")
    return [table[name].to_numpy()[order] for name in names]


@dataclass
class _Heard:
    """The rows of a match in the order of ticks, and its heroes: their numbers ``hero``, the cells of their fountains and
    goals, the observing teams and the number of each hero's."""

    ticks: np.ndarray
    hero: np.ndarray
    alive: np.ndarray
    seen: np.ndarray
    #: The cell of a sighting, -1 where there is none.
    place: np.ndarray
    homes: np.ndarray
    goals: list[np.ndarray]
    teams: np.ndarray
    row: np.ndarray


def _heard(seen: pa.Table, ground: Ground) -> _Heard:
    frame = seen.select(["slot", "team", "role", "tick"]).to_pandas()
    heroes = frame.sort_values("tick").groupby("slot").agg(team=("team", "first"), role=("role", "first")).reset_index()
    homes = np.array([ground.nearest_open(int(ground.cell_of(*world(FOUNTAINS[1 - int(t)])))) for t in heroes["team"]])
    goals = []
    for role, team in zip(heroes["role"], heroes["team"]):
        cells = ground.cell_of(*np.array(places_of(role, 1 - int(team))).T)
        cells = np.unique(cells[ground.raster.open.ravel()[cells]])
        goals.append(cells if len(cells) else ground.open[:1])
    ticks, slot, is_alive, is_seen, x, z = _sorted(seen, ["tick", "slot", "alive", "seen", "x", "z"])
    hero = np.searchsorted(heroes["slot"].to_numpy(), slot)
    is_alive, is_seen = is_alive.astype(bool), is_seen.astype(bool)
    place = np.full(len(slot), -1)
    known = np.flatnonzero(is_seen & ~np.isnan(x.astype(float)) & ~np.isnan(z.astype(float)))
    place[known] = ground.cell_of(x[known].astype(float), z[known].astype(float))
    return _Heard(ticks, hero, is_alive, is_seen, place, homes, goals, *np.unique(heroes["team"].to_numpy(int), return_inverse=True))


def _chances(heard: _Heard, lit: pa.Table, model: BeliefModel, ground: Ground) -> Callable[[int], np.ndarray]:
    """The chance of being seen at a tick, by [team, cell]."""
    teams, final = heard.teams, heard.ticks[-1]
    blind = np.zeros((len(teams), ground.side**2))
    if not model.negative or not lit.num_rows:
        return lambda tick: blind
    first, last, team, *where = (c.astype(float) for c in _sorted(lit, ["tick", "last", "team", "x", "z", "r"]))
    places, which = np.unique(np.stack(where, 1), axis=0, return_inverse=True)
    sight = Sight(ground, *places.T, model)
    first, last = np.maximum(first, 0).astype(int), np.minimum(last, final).astype(int)
    n_lit = np.where(np.isin(team, teams), np.maximum(last - first + 1, 0), 0)
    span = np.repeat(np.arange(len(first)), n_lit)
    when = first[span] + np.arange(len(span)) - np.repeat(np.cumsum(n_lit) - n_lit, n_lit)
    # Once for each tick, team and place, in this order.
    by, place_no = np.divmod(np.unique((when * len(teams) + np.searchsorted(teams, team[span])) * len(places) + which.ravel()[span]), len(places))
    at, start = np.unique(by, return_index=True)
    sources_of = {divmod(k, len(teams)): s for k, s in zip(at.tolist(), np.split(place_no, start[1:]))}

    def chance(tick: int) -> np.ndarray:
        found = [sources_of.get((tick, k)) for k in range(len(teams))]
        return np.stack([blind[0] if s is None else sight.detection(s) for s in found]) if any(s is not None for s in found) else blind

    return chance


def believe(key: tuple[str, str], seen: pa.Table, lit: pa.Table, model: BeliefModel, raster: Raster, cell: float, tick_s: float, mass: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows of ``seen`` in the order of ticks, ess, entropy, area, how many bins of each, bins, p) for each tick that has rows."""
    match_id, _ = key
    ground = _ground(raster, cell)
    heard = _heard(seen, ground)
    hero, n = heard.hero, len(heard.homes)
    filters = Filters(ground, model, heard.homes, heard.goals, tick_s, np.random.default_rng(_seed(match_id)))
    histogram = Histogram(ground, model.smoothing)
    n_open = int(histogram.open.sum())
    chance = _chances(heard, lit, model, ground)
    ends = np.searchsorted(heard.ticks, np.arange(int(heard.ticks[-1]) + 2))

    def readings(cells: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        p = histogram(cells, weight)
        ess = 1 / (weight * weight).sum(1)
        at, bins = np.nonzero(p)
        return ess, entropy_bits(p, ess, n_open), densest(p, mass), np.bincount(at, minlength=len(p)), bins.astype(np.int32), p[at, bins]

    for tick in range(len(ends) - 1):
        rows = slice(ends[tick], ends[tick + 1])
        alive, spotted, observed = np.ones(n, bool), np.zeros(n, bool), np.full(n, -1)
        at = hero[rows]
        alive[at], spotted[at] = heard.alive[rows], heard.seen[rows]
        where = heard.place[rows]
        observed[at[where >= 0]] = where[where >= 0]
        filters.tick(tick, alive, spotted, observed, chance(tick), heard.row)
        if not len(at):
            continue
        # A hero that is seen, or dead, is in one cell with all its particles: read once for each cell and Python worker.
        one = ~alive | (spotted & (observed >= 0) & model.positive)
        point = [(int(filters.cell[k, 0]), model.particles, model.smoothing, mass) if one[k] else None for k in range(n)]
        whole: list[tuple | None] = [ground.points.get(p) for p in point]
        unread = [k for k in range(n) if whole[k] is None]
        if unread:
            ess, bits, area, size, bins, p = readings(filters.cell[unread], filters.weight[unread])
            cut = np.cumsum(size)
            for m, k in enumerate(unread):
                part = slice(cut[m] - size[m], cut[m])
                whole[k] = ess[m : m + 1], bits[m : m + 1], area[m : m + 1], size[m : m + 1], bins[part], p[part]
                if point[k]:
                    if len(ground.points) >= 16_384:
                        ground.points.clear()
                    ground.points[point[k]] = tuple(c.copy() for c in whole[k])
        yield rows, *(np.concatenate(c) for c in zip(*(whole[k] for k in at.tolist())))


def beliefs(observations: DataFrame, sources: DataFrame, models: list[BeliefModel], raster: Raster, cell: float, tick_s: float = 1.0, mass: float = 0.9, matches: int | None = None, bins: bool = True, known: DataFrame | None = None, read: Reading | None = None) -> DataFrame:
    """(model, match_id, slot, tick, alive, seen, ess, entropy, area, bins, p): the belief in each hero at every tick, by bins
    of the lattice, with its entropy in bits and the number of densest bins that hold ``mass``. Without ``bins`` the same rows,
    but for the two arrays. With ``read`` its columns are added: what it makes of the whole beliefs where they arise, so that
    their arrays needn't travel. ``known``, one row for each match_id, slot and tick, has more columns for it alone; the
    filter doesn't get them, and null stands where there is no row.

    ``observations``: match_id, slot, team (the observer's), role, tick, alive, seen, x, z, with x and z only where seen: the
    filter reads no truth. ``sources``: match_id, tick, team, x, z, r, the observer's sources of sight, and, if they stay in
    one place, ``last``, the last tick of each.

    Method: particles on the cells of ``raster`` move by the model's motion, gather in the cell of a sighting, and lose
    weight where the observer looks and sees nothing; they are drawn anew by systematic resampling, or from the cells in
    reach that lie in the dark when too few are left. Dead heroes stand still and begin again at their fountain.

    A group is a match with one model, its heroes side by side, with rows in proportion to the match's length; models are
    groups of their own. Draws are seeded by the match, so results don't depend on the order of tasks. ``matches``, how many
    there are, spreads the groups over as many partitions (64 to one beyond 2,000): a group takes time, not bytes.

    Defined results: rows with a null key, team or tick are left out; no observations give no rows; a hero without sources
    loses nothing by being unseen; a sighting without a position tells nothing.
    """
    kinds = lambda some: F.explode(F.array(*[F.lit(m.name) for m in some]).cast("array<string>"))
    left = observations.filter("match_id IS NOT NULL AND slot IS NOT NULL AND team IS NOT NULL AND tick IS NOT NULL").select("match_id", kinds(models).alias("model"), "slot", "team", "role", "tick", "alive", "seen", "x", "z")
    extra = [c for c in known.columns if c not in _KEYS] if known is not None else []
    if known is not None:
        left = left.join(known, _KEYS, "left")
    # Only models that heed the absence of sightings look at the sources.
    right = sources.filter("match_id IS NOT NULL AND tick IS NOT NULL").select("match_id", kinds([m for m in models if m.negative]).alias("model"), "tick", (F.coalesce("last", "tick") if "last" in sources.columns else F.col("tick")).alias("last"), "team", "x", "z", "r")
    by_name = {m.name: m for m in models}
    schema = pa.schema([*(f for f in _OUT if bins or f.name not in ("bins", "p")), *(read.schema if read else [])])

    def run(key: tuple, seen: pa.Table, lit: pa.Table) -> pa.Table:
        if not seen.num_rows:
            return schema.empty_table()
        match_id, name = (k.as_py() for k in key)
        parts = [*zip(*believe((match_id, name), seen.drop_columns(extra), lit, by_name[name], raster, cell, tick_s, mass))]
        slot, tick, alive, spotted = _sorted(seen, ["slot", "tick", "alive", "seen"])
        rows = np.concatenate([np.arange(r.start, r.stop) for r in parts[0]])
        ess, entropy, area, size, bin_no, p = (np.concatenate(c) for c in parts[1:])
        columns = [pa.array([name] * len(rows), pa.string()), pa.array([match_id] * len(rows), pa.string()), slot[rows].astype(np.int32), tick[rows].astype(np.int32), alive[rows].astype(bool), spotted[rows].astype(bool), ess, entropy, area.astype(np.int32)]
        if bins:
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            columns += [pa.ListArray.from_arrays(ends, pa.array(bin_no)), pa.ListArray.from_arrays(ends, pa.array(p))]
        if read:
            more = dict(zip(extra, (c[rows] for c in _sorted(seen, extra))))
            columns += read.of(alive[rows].astype(bool) & ~spotted[rows].astype(bool), size, bin_no, p, more)
        return pa.table(columns, schema=schema)

    if matches:
        groups = matches * len(models)
        parts = max(min(groups, 2000), groups // 64)
        left, right = left.repartition(parts, "match_id", "model"), right.repartition(parts, "match_id", "model")
    return left.groupBy("match_id", "model").cogroup(right.groupBy("match_id", "model")).applyInArrow(run, from_arrow_schema(schema))


#: Levels at which coverage is measured.
LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
_SUMS = pa.schema([
    ("model", pa.string()), ("match_id", pa.string()), *((c, pa.int64()) for c in ("n_rows", "n_dark", "n_alive", "n_dark_alive", "n")),
    *((c, pa.float64()) for c in ("nll", "entropy", "area")), ("n_covered", pa.list_(pa.int64())),
])


def belief_sums(observations: DataFrame, sources: DataFrame, models: list[BeliefModel], raster: Raster, cell: float, bin_area: float, tick_s: float = 1.0, mass: float = 0.9, matches: int | None = None) -> DataFrame:
    """(model, match_id, n_rows, n_dark, n_alive, n_dark_alive, n, nll, entropy, area, n_covered): how good the ``beliefs`` of
    each model in the heroes of a match are. n counts the rows of living, hidden heroes with a ``true_bin``, which is a column
    of ``observations`` here and not known to the filter; nll, entropy and area are sums over them, n_covered how many of them
    have a pit of at most each of the ``LEVELS``. The density is p_true (half a particle at least) over ``bin_area``.

    Method: a match is a group, its models one after the other, so that it is sent once and not once for each of them; only
    sums leave the task. Beliefs are those of ``beliefs``, draw by draw; ``Scorer`` looks at those of many ticks together,
    and no others are looked at. Defined results and ``matches`` as there.
    """
    left = observations.filter("match_id IS NOT NULL AND slot IS NOT NULL AND team IS NOT NULL AND tick IS NOT NULL").select("match_id", "slot", "team", "role", "tick", "alive", "seen", "x", "z", "true_bin")
    right = sources.filter("match_id IS NOT NULL AND tick IS NOT NULL").select("match_id", "tick", (F.coalesce("last", "tick") if "last" in sources.columns else F.col("tick")).alias("last"), "team", "x", "z", "r")
    if not any(m.negative for m in models):
        right = right.filter("false")

    def run(key: tuple, seen: pa.Table, lit: pa.Table) -> pa.Table:
        if not seen.num_rows:
            return _SUMS.empty_table()
        match_id, ground = key[0].as_py(), _ground(raster, cell)
        heard = _heard(seen.drop_columns(["true_bin"]), ground)
        true_bin = _sorted(seen, ["true_bin"])[0].astype(float)
        shape = max(0, int(heard.ticks[-1]) + 1), len(heard.homes)
        early = heard.ticks < 0
        ticks, hero = np.maximum(heard.ticks, 0), heard.hero
        alive, spotted, observed = np.ones(shape, bool), np.zeros(shape, bool), np.full(shape, -1)
        at, placed = (ticks[~early], hero[~early]), ~early & (heard.place >= 0)
        alive[at], spotted[at] = heard.alive[~early], heard.seen[~early]
        observed[ticks[placed], hero[placed]] = heard.place[placed]
        rated = ~early & heard.alive & ~heard.seen & ~np.isnan(true_bin)
        spot = ticks[rated], hero[rated]
        asked, true = np.zeros(shape, bool), np.zeros(shape, np.int64)
        asked[spot], true[spot] = True, true_bin[rated].astype(np.int64)
        dark, out = ~heard.seen[~early], []
        rows = len(dark), int(dark.sum()), int(heard.alive[~early].sum()), int((dark & heard.alive[~early]).sum()), int(rated.sum())
        for model in models:
            line = Timeline(alive, spotted, observed, heard.homes, heard.goals, _chances(heard, lit, model, ground), heard.row)
            whole = scores(ground, model, line, asked, true, tick_s, mass, np.random.default_rng(_seed(match_id)))
            p_true, pit, entropy, area = (c[spot] for c in whole)
            nll = -np.log(np.maximum(p_true, 0.5 / model.particles) / bin_area)
            out.append((model.name, match_id, *rows, nll.sum(), entropy.sum(), area.sum(), [int((pit <= q).sum()) for q in LEVELS]))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _SUMS)], schema=_SUMS)

    if matches:
        parts = max(min(matches, 2000), matches // 64)
        left, right = left.repartition(parts, "match_id"), right.repartition(parts, "match_id")
    return left.groupBy("match_id").cogroup(right.groupBy("match_id")).applyInArrow(run, from_arrow_schema(_SUMS))


def mass_at(bin_no: Column) -> Column:
    """The belief's probability of a bin."""
    return F.coalesce(F.element_at("p", F.when(F.array_position("bins", bin_no) > 0, F.array_position("bins", bin_no).cast("int"))), F.lit(0.0))


def _scores(asked: np.ndarray, size: np.ndarray, bins: np.ndarray, p: np.ndarray, known: dict[str, np.ndarray]) -> list:
    """p_true and pit of the rows that are asked about and whose true_bin is known; null for the others."""
    true = known["true_bin"].astype(float)
    good = asked & ~np.isnan(true)
    row = np.repeat(np.arange(len(size)), size)
    # Sums in the order of the bins.
    whole = lambda values: np.bincount(row, values, len(size))
    p_true = whole(np.where(bins == true[row], p, 0.0))
    pit = whole(np.where(p > p_true[row], p, 0.0)) + p_true
    return [pa.array(v, mask=~good) for v in (p_true, pit)]


#: For ``known`` with true_bin; see ``scored``, which makes the same of beliefs that are already there.
SCORES = Reading(pa.schema({"p_true": pa.float64(), "pit": pa.float64()}), _scores)


def _whole(asked: np.ndarray, size: np.ndarray, bins: np.ndarray, p: np.ndarray, known: dict[str, np.ndarray]) -> list:
    if not len(bins) == len(p) == size.sum():
        return [np.zeros(len(size), bool)]
    row = np.repeat(np.arange(len(size)), size)
    return [(np.abs(np.bincount(row, p, len(size)) - 1) <= 1e-6) & (np.bincount(row, p < 0, len(size)) == 0)]


#: Whether a belief is one: as many bins as probabilities, none below 0, with the sum 1.
WHOLE = Reading(pa.schema({"whole": pa.bool_()}), _whole)


def scored(belief: DataFrame, truth: DataFrame, every: bool = False) -> DataFrame:
    """``belief`` of the alive and unseen heroes whose true place is known, with p_true and pit; with ``every``, all of
    ``belief``, and the two null where that isn't so.

    ``truth``: match_id, slot, tick, true_bin. pit is the mass of the bins denser than the true one, and its own.
    """
    asked = F.col("alive") & ~F.col("seen")
    joined = belief.join(truth, ["match_id", "slot", "tick"], "left") if every else belief.filter(asked).join(truth, ["match_id", "slot", "tick"])
    joined = joined.withColumn("p_true", F.when(asked & F.col("true_bin").isNotNull(), mass_at(F.col("true_bin"))))
    denser = F.aggregate(F.filter("p", lambda v: v > F.col("p_true")), F.lit(0.0), lambda a, v: a + v)
    return joined.withColumn("pit", F.when(F.col("p_true").isNotNull(), denser + F.col("p_true")))
