"""Beliefs of a whole match scored against the truth: particles of many ticks are looked at together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from mistrail.functions.filtering import LATTICE, BeliefModel, Filters, Ground, Histogram

#: Beliefs that are scored together; their particles stay in the processor's cache. Bins of a row of the lattice and a
#: place beside it.
ROWS, WIDE = 32, LATTICE + 1


def entropy_bits(p: np.ndarray, ess: np.ndarray, bins: int) -> np.ndarray:
    """Entropy of each row with the Miller-Madow correction for ``ess`` draws, at most that of ``bins`` equal bins."""
    plain = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(1)
    return np.minimum(plain + np.where(ess > 0, ((p > 0).sum(1) - 1) / (2 * np.where(ess > 0, ess, 1.0) * np.log(2)), 0.0), np.log2(max(1, bins)))


def densest(p: np.ndarray, mass: float) -> np.ndarray:
    """How many bins of each row, the densest first, hold ``mass``."""
    upto = np.cumsum(-np.sort(-p, axis=1), axis=1)
    return np.minimum((upto < mass - 1e-12).sum(1) + 1, p.shape[1])


@dataclass
class Timeline:
    """What is observed of the heroes of a match, by [tick, hero]. ``observed`` is the cell of a sighting, -1 where there is
    none. ``chance`` gives, for a tick, the chance of being seen by [team, cell], and ``row`` the team's row of each hero."""

    alive: np.ndarray
    seen: np.ndarray
    observed: np.ndarray
    home: np.ndarray
    goals: list[np.ndarray]
    chance: Callable[[int], np.ndarray]
    row: np.ndarray


class Scorer:
    """p_true, pit, entropy and area of beliefs with their true bins; see ``scored`` and ``entropy_bits``.

    Particles of equal weight are counted: a smoothed bin is then a whole number of 32nds of a particle, and sums of bins
    have no rounding. Particles of other weights, or smoothed otherwise, go through ``Histogram``.
    """

    def __init__(self, ground: Ground, model: BeliefModel, mass: float):
        self.particles, self.mass, self.histogram = model.particles, mass, Histogram(ground, model.smoothing)
        self.whole = model.smoothing == 0.25 and model.particles < 1 << 20
        self.open, self.n_open = self.histogram.open.astype(np.int32), int(self.histogram.open.sum())
        # Bins lie in rows of one more with one more row above and below, so that neighbours are a fixed way apart.
        i, j = np.divmod(self.histogram.bin_of, LATTICE)
        self.padded, self.size = (i + 1) * WIDE + j, (LATTICE + 2) * WIDE
        if self.whole:
            n = np.arange(24 * model.particles + 1)
            #: n * log2(n).
            self.log = n * np.log2(np.maximum(n, 1))

    def __call__(self, cell: np.ndarray, true: np.ndarray, weight: np.ndarray | None = None) -> list[np.ndarray]:
        """Of cells (and weights, unless they are equal) of [row, particle], and the true bin of each row."""
        cuts = range(0, len(cell), ROWS)
        of = [self._even(cell[k : k + ROWS], true[k : k + ROWS]) if weight is None and self.whole else self._any(cell[k : k + ROWS], true[k : k + ROWS], None if weight is None else weight[k : k + ROWS]) for k in cuts]
        return [np.concatenate(c) for c in zip(*of)]

    def _any(self, cell: np.ndarray, true: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, ...]:
        weight = np.full(cell.shape, 1 / cell.shape[1]) if weight is None else weight
        p = self.histogram(cell, weight)
        p_true = p[np.arange(len(p)), true]
        pit = (p * (p > p_true[:, None])).sum(1) + p_true
        return p_true, pit, entropy_bits(p, 1 / (weight * weight).sum(1), self.n_open), densest(p, self.mass)

    def _even(self, cell: np.ndarray, true: np.ndarray) -> tuple[np.ndarray, ...]:
        n, bins = len(cell), LATTICE**2
        row = np.arange(n)
        at = self.padded.take(cell)
        at += (row * self.size)[:, None]
        count = np.bincount(at.ravel(), minlength=n * self.size).astype(np.int32)
        # What gets into the cells beside the lattice is left there.
        side = count.copy()
        side[1:] += count[:-1]
        side[:-1] += count[1:]
        m = side.copy()
        m[WIDE:] += side[:-WIDE]
        m[:-WIDE] += side[WIDE:]
        count *= 23
        m += count
        m = (m.reshape(n, LATTICE + 2, WIDE)[:, 1:-1, :LATTICE] * self.open.reshape(LATTICE, LATTICE)).reshape(n, bins)
        total = m.sum(1)
        if not total.all():
            m[total == 0] = self.open
            total = m.sum(1)
        own = m[row, true].astype(np.int64)
        ranked = np.sort(m, axis=1)
        # Both ascend from row to row, too.
        upto = np.cumsum(ranked, dtype=np.int32)
        ranked = ranked + (row << 32)[:, None] if self.particles >= 1 << 15 else ranked + (row << 16).astype(np.int32)[:, None]
        begin, shift = row * bins, 32 if self.particles >= 1 << 15 else 16
        place = np.searchsorted(ranked.ravel(), np.concatenate([own + (row << shift), row << shift]).astype(ranked.dtype), "right")
        up_to_own, n_none = place[:n], place[n:] - begin
        before = upto[begin + bins - 1] - total
        denser = before + total - upto[up_to_own - 1]
        plain = np.log2(total) - self.log.take(m).sum(1) / total
        entropy = np.minimum(plain + (bins - n_none - 1) / (2 * self.particles * np.log(2)), np.log2(max(1, self.n_open)))
        area = bins - (np.searchsorted(upto, before + total - total * (self.mass - 1e-12), "right") - begin)
        return own / total, (denser + own) / total, entropy, area


def _last_seen(line: Timeline, positive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, last, last_tick) by [tick, hero]: whether a hero is sighted, and where and when it was, before this tick's
    sighting, but after a new beginning at its fountain."""
    found = line.alive & line.seen & (line.observed >= 0) & positive
    last, when = np.empty(found.shape, np.int64), np.empty(found.shape, np.int64)
    at, since, lived = line.home.copy(), np.zeros(len(line.home), np.int64), np.ones(len(line.home), bool)
    for tick in range(len(found)):
        born = line.alive[tick] & ~lived
        at, since, lived = np.where(born, line.home, at), np.where(born, tick, since), line.alive[tick]
        last[tick], when[tick] = at, since
        at, since = np.where(found[tick], line.observed[tick], at), np.where(found[tick], tick, since)
    return found, last, when


def _drawn(ground: Ground, model: BeliefModel, line: Timeline, asked: np.ndarray, tick_s: float, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Beliefs that are drawn anew at each tick (uniform, disc, geodisc), with the draws of ``Filters``."""
    p, side = model.particles, ground.side
    found, last, when = _last_seen(line, model.positive)
    # A hero that is dead or in sight is in one cell.
    fixed = np.nonzero(asked & (found | ~line.alive))
    if len(fixed[0]):
        yield *fixed, np.repeat(np.where(found, line.observed, last)[fixed][:, None], p, 1)
    asked = asked & line.alive & ~found
    tick, hero = np.nonzero(line.alive)
    far = model.fastest * (np.maximum(0, tick - when[tick, hero]) * tick_s)
    start, wanted = last[tick, hero], asked[tick, hero]
    if model.motion == "geodisc":
        ground.prepare_balls(np.unique(start))
    for k in range(0, len(tick), ROWS):
        part = slice(k, k + ROWS)
        want, n = np.flatnonzero(wanted[part]), len(tick[part])
        if model.motion == "uniform":
            cell = ground.open.take(rng.integers(0, len(ground.open), n * p).reshape(n, p)[want])
        elif model.motion == "disc":
            draw = rng.random((n, 2, p))[want]
            angle, r = draw[:, 0] * (2 * np.pi), far[part][want][:, None] * np.sqrt(draw[:, 1])
            i, j = (np.stack(np.divmod(start[part][want], side)) + 0.5)[:, :, None] * ground.cell
            at = lambda v: np.minimum((np.maximum(v, 0) / ground.cell).astype(np.int64), side - 1)
            cell = at(i + r * np.cos(angle)) * side + at(j + r * np.sin(angle))
        else:
            cell = np.empty((len(want), p), np.int64)
            row = np.full(n, -1)
            row[want] = np.arange(len(want))
            for s, radius, to in zip(start[part].tolist(), far[part].tolist(), row.tolist()):
                cells = ground.within(s, radius)
                draw = rng.integers(0, len(cells), p)
                if to >= 0:
                    cell[to] = cells.take(draw)
        if len(want):
            yield tick[part][want], hero[part][want], cell


def scores(ground: Ground, model: BeliefModel, line: Timeline, asked: np.ndarray, true: np.ndarray, tick_s: float, mass: float, rng: np.random.Generator) -> list[np.ndarray]:
    """p_true, pit, entropy and area by [tick, hero] of the beliefs that are ``asked`` for, with their ``true`` bins; NaN for
    the others. The beliefs are those of ``Filters``, particle by particle."""
    if (key := (model.particles, model.smoothing, mass)) not in ground.scorers:
        ground.scorers[key] = Scorer(ground, model, mass)
    scorer = ground.scorers[key]
    out = [np.full(asked.shape, np.nan) for _ in range(4)]

    def put(tick: np.ndarray, hero: np.ndarray, values: list[np.ndarray]) -> None:
        for to, v in zip(out, values):
            to[tick, hero] = v

    if model.motion in ("uniform", "disc", "geodisc") and not model.negative:
        for tick, hero, cell in _drawn(ground, model, line, asked, tick_s, rng):
            put(tick, hero, scorer(cell, true[tick, hero]))
        return out
    filters = Filters(ground, model, line.home, line.goals, tick_s, rng)
    waiting: list[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]] = []
    n_waiting = 0

    def score() -> None:
        for even in (True, False):
            some = [w for w in waiting if (w[3] is None) == even]
            if some:
                tick = np.concatenate([np.full(len(h), t) for t, h, _, _ in some])
                hero, cell = (np.concatenate([w[k] for w in some]) for k in (1, 2))
                put(tick, hero, scorer(cell, true[tick, hero], None if even else np.concatenate([w[3] for w in some])))
        waiting.clear()

    for tick in range(len(asked)):
        filters.tick(tick, line.alive[tick], line.seen[tick], line.observed[tick], line.chance(tick), line.row)
        heroes = np.flatnonzero(asked[tick])
        for some in (heroes[filters.is_even[heroes]], heroes[~filters.is_even[heroes]]):
            if len(some):
                waiting.append((tick, some, filters.cell[some], None if filters.is_even[some[0]] else filters.weight[some]))
                n_waiting += len(some)
        if n_waiting >= 4 * ROWS:
            score()
            n_waiting = 0
    score()
    return out
