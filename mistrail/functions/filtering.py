"""Particle filters on a raster: how a belief moves, what it learns from sight, and its histogram."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from mistrail.functions.ground import STEP, Raster, walks_from, walks_within

LATTICE = 32
#: Bytes that the tables of steps towards goals may take.
STRIDES = 64 << 20
#: Steps to the eight neighbours (di, dj), and standing still.
MOVES = np.array([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
STAY = 8
#: Parts into which draws are cut to look steps up, the mark of parts in which the step depends on the draw, and bytes that
#: the tables for it may take.
PARTS, UNSURE, GUIDES = 64, 255, 192 << 20


@dataclass(frozen=True)
class BeliefModel:
    """One way to believe; the models of an ablation differ in single fields. Lengths are in units of the map."""

    name: str = "full"
    #: uniform, disc, geodisc, constant (velocity), diffusion or behavioural (a walk towards goals).
    motion: str = "behavioural"
    #: Whether sightings count, and whether their absence does.
    positive: bool = True
    negative: bool = True
    particles: int = 1024
    sub_steps: int = 2
    stay: float = 0.10
    persistence: float = 1.0
    goal_beta: float = 0.45
    arrive: float = 461.0
    fastest: float = 450.0
    inside: float = 0.98
    edge: float = 0.75
    ring: float = 57.7
    #: Share of the particles below which the effective sample size calls for new draws, or for a new beginning.
    resample: float = 0.5
    deplete: float = 0.05
    #: Share of a bin's mass that its neighbours get in the histogram.
    smoothing: float = 0.25

    def __post_init__(self) -> None:
        if not 0 <= self.stay < 1:
            raise ValueError("stay must be in [0, 1)")
        if self.particles < LATTICE * LATTICE:
            raise ValueError("fewer particles than bins would cap the entropy")


#: The models that are compared; the last two differ by what the absence of a sighting tells.
MODELS = [
    BeliefModel("uniform", "uniform", False, False), BeliefModel("disc", "disc", True, False), BeliefModel("geodisc", "geodisc", True, False), BeliefModel("constant", "constant", True, False),
    BeliefModel("diffusion", "diffusion", True, False), BeliefModel("behavioural", "behavioural", True, False), BeliefModel("full", "behavioural", True, True),
]


@dataclass
class Strides:
    """Steps towards some goals, by [goal, cell]: the weights of the moves, and whether the goal is close by. ``first`` has
    the row at which each goal begins, -1 for cells that aren't among them."""

    first: np.ndarray
    weight: np.ndarray
    close: np.ndarray


class Ground:
    """A raster made ready for walks: neighbours and weights of every cell, distances from the cells asked for."""

    def __init__(self, raster: Raster, cell: float):
        self.raster, self.cell, self.side = raster, cell, raster.side
        side = raster.side
        self.open = np.flatnonzero(raster.open.ravel())
        i, j = np.divmod(np.arange(side * side), side)
        pad = np.pad(raster.open, 1)
        self.to = np.empty((side * side, 8), np.int64)
        self.weight = np.empty((side * side, 8))
        for m, (di, dj) in enumerate(MOVES):
            ok = pad[i + 1 + di, j + 1 + dj] & pad[i + 1 + di, j + 1] & pad[i + 1, j + 1 + dj]
            self.to[:, m] = np.where(ok, (i + di) * side + j + dj, 0)
            self.weight[:, m] = np.where(ok, 1.0 if not di or not dj else 70 / 99, 0.0)
        #: Where each move leads to (the ninth: nowhere), and a number whose difference between two cells tells the way.
        self.to_or_stay = np.concatenate([self.to, np.arange(side * side)[:, None]], 1).ravel()
        self.key = i * (2 * side - 1) + j
        self.balls: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
        #: Cells and walks in STEPths of a cell, nearest first, of the whole ground.
        self.whole_balls: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.pulls: dict[float, np.ndarray] = {}
        self.near: dict[float, np.ndarray] = {}
        self.strides: dict[tuple, Strides] = {}
        self.guides: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        #: Readings of particles that are all in one cell.
        self.points: dict[tuple, tuple[np.ndarray, ...]] = {}
        #: What functions/scoring.py keeps between matches.
        self.scorers: dict[tuple, object] = {}

    def cell_of(self, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        at = lambda v: np.clip((v / self.cell).astype(np.int64), 0, self.side - 1)
        return at(np.asarray(x)) * self.side + at(np.asarray(z))

    def nearest_open(self, cell: int) -> int:
        if self.raster.open.ravel()[cell]:
            return cell
        i, j = divmod(cell, self.side)
        a, b = np.divmod(self.open, self.side)
        return int(self.open[np.argmin((a - i) ** 2 + (b - j) ** 2)])

    def ball(self, cell: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """The open cells that can be walked to from ``cell`` (the nearest open one), nearest first, and how far they are; at
        least all those within ``radius``. It is doubled until the whole ground is in it: most are asked for close by."""
        known = self.balls.get(cell)
        if known is None or known[0] < radius:
            upto, longest = 8 * self.cell, 2 * self.side * self.side * self.cell
            while upto < min(radius, longest):
                upto *= 2
            i, j = divmod(self.nearest_open(cell), self.side)
            far, low_i, low_j = walks_within(self.raster.open, i, j, int(upto / self.cell * STEP) + 1)
            a, b = np.nonzero(far >= 0)
            order = np.argsort(far[a, b], kind="stable")
            known = upto if upto < longest else np.inf, ((a + low_i) * self.side + b + low_j)[order], far[a, b][order] * (self.cell / STEP)
            while len(self.balls) >= 4096:
                self.balls.pop(next(iter(self.balls)))
            self.balls[cell] = known
        return known[1:]

    def prepare_balls(self, cells: np.ndarray) -> None:
        """Works out the whole balls around ``cells`` together, where the ground is small enough to keep them."""
        if self.side * self.side > 4096:
            return
        new = [int(c) for c in cells if int(c) not in self.whole_balls]
        starts = np.array([self.nearest_open(c) for c in new], np.int64)
        for k in range(0, len(new), 256):
            for cell, row in zip(new[k : k + 256], walks_from(self.raster.open, starts[k : k + 256])):
                at = np.flatnonzero(row >= 0)
                far = row[at]
                if far.max() < 1 << 15:
                    far = far.astype(np.int16)
                order = np.argsort(far, kind="stable")
                self.whole_balls[cell] = at[order].astype(np.int16), far[order]

    def within(self, cell: int, radius: float) -> np.ndarray:
        """The open cells within a walk of ``radius`` units from ``cell``, and at least of one cell."""
        radius = max(radius, self.cell)
        if (whole := self.whole_balls.get(cell)) is not None:
            cells, far = whole
            return cells[: max(1, int(far.searchsorted(self._steps(radius, int(far[-1])), "right")))]
        cells, far = self.ball(cell, radius)
        return cells[: max(1, int(np.searchsorted(far, radius, "right")))]

    def _steps(self, radius: float, longest: int) -> np.ndarray:
        """The longest walk in STEPths of a cell, up to ``longest``, that is within ``radius`` units; of the type of balls."""
        scale = self.cell / STEP
        most = min(longest, int(radius / scale) + 1)
        while most > 0 and most * scale > radius:
            most -= 1
        return np.int16(most) if longest < 1 << 15 else np.int64(most)

    def way(self, cell: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Number of the way from each cell to its goal, for ``pull`` and ``close``."""
        return self.key.take(goal) - self.key.take(cell) + (self.side - 1) * 2 * self.side

    def _ways(self) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(np.arange((2 * self.side - 1) ** 2), 2 * self.side - 1)

    def pull(self, beta: float) -> np.ndarray:
        """[way, move]: how much likelier the way to the goal makes each move: by the cosine between the two; 1 at the goal."""
        if beta not in self.pulls:
            to = np.stack(self._ways(), 1).astype(np.float32) - np.float32(self.side - 1)
            norm = np.sqrt((to * to).sum(1, keepdims=True))
            self.pulls[beta] = np.exp(to / np.where(norm > 0, norm, 1) @ (beta * MOVES / np.hypot(*MOVES.T)[:, None]).T.astype(np.float32))
        return self.pulls[beta]

    def close(self, gap: float) -> np.ndarray:
        """[way]: whether its length is at most ``gap`` units."""
        if gap not in self.near:
            di, dj = self._ways()
            self.near[gap] = np.hypot(di - self.side + 1, dj - self.side + 1) * self.cell <= gap
        return self.near[gap]

    def prepare(self, goals: np.ndarray, model: BeliefModel) -> Strides | None:
        """The weights of steps towards ``goals``, worked out once for every cell; None where they would take too much memory."""
        key, n = (model.goal_beta, model.arrive), self.side * self.side
        known = self.strides.get(key) or Strides(np.full(n, -1), np.empty((0, 8)), np.empty(0, bool))
        new = np.unique(goals)
        new = new[known.first[new] < 0]
        if (len(known.close) + len(new) * n) * 8 * 8 > STRIDES:
            return None
        if len(new):
            way = self.way(np.arange(n), new[:, None]).ravel()
            known.first[new] = len(known.close) + np.arange(len(new)) * n
            known.weight = np.concatenate([known.weight, np.tile(self.weight, (len(new), 1)) * self.pull(model.goal_beta).take(way, 0)])
            known.close = np.concatenate([known.close, self.close(model.arrive).take(way)])
        self.strides[key] = known
        return known

    def guide(self, model: BeliefModel, strides: Strides | None) -> tuple[np.ndarray, np.ndarray] | None:
        """By row of the weights and heading: [part of the draws], the step that every draw of the part leads to, UNSURE where
        they differ, and [move], the weights of the moves up to each; None where that would take too much memory."""
        key = (strides is None, model.goal_beta, model.arrive, model.persistence, model.stay)
        weight = self.weight if strides is None else strides.weight
        known = self.guides.get(key, (np.empty((0, PARTS), np.uint8), np.empty((0, 8))))
        if len(known[0]) == len(weight) * (STAY + 1):
            return known
        if len(weight) * (STAY + 1) * (PARTS + 64) > GUIDES:
            return None
        boost = self._boost(model)
        guides, sums = [known[0]], [known[1]]
        for row in range(len(known[0]) // (STAY + 1), len(weight), 1024):
            w = (weight[row : row + 1024, None] * boost).reshape(-1, 8)
            for m in range(1, 8):
                w[:, m] += w[:, m - 1]
            total = w[:, -1:] / (1 - model.stay)
            # Where in the draws each move ends; close to the edge between two parts both are unsure.
            end = w / np.where(total > 0, total, 1.0) * PARTS
            low, high = (np.where(w > 0, np.clip(np.floor(end + e), -1, PARTS), -1).astype(np.int64) for e in (-1e-6, 1e-6))
            # The step of a part is the number of moves that end before it.
            at = np.arange(len(w))[:, None] * (PARTS + 2)
            new = np.cumsum(np.bincount((at + high + 1).ravel(), minlength=len(w) * (PARTS + 2)).astype(np.uint8).reshape(-1, PARTS + 2), axis=1, dtype=np.uint8)[:, :PARTS]
            for part in (low, high):
                r, m = np.nonzero((part >= 0) & (part < PARTS))
                new[r, part[r, m]] = UNSURE
            guides.append(new)
            sums.append(w)
        self.guides[key] = np.concatenate(guides), np.concatenate(sums)
        return self.guides[key]

    @staticmethod
    def _boost(model: BeliefModel) -> np.ndarray:
        """[heading, move]: how much likelier the old heading makes each move."""
        boost = np.ones((STAY + 1, 8))
        boost[np.arange(8), np.arange(8)] += model.persistence
        return boost

    def matrix(self, stay: float) -> np.ndarray:
        """Chance of each cell after one step from each, without heading and goal."""
        n = self.side * self.side
        total = self.weight.sum(1)
        m = np.zeros((n, n))
        np.add.at(m, (np.repeat(np.arange(n), 8), self.to.ravel()), (self.weight / np.where(total > 0, total, 1.0)[:, None] * (1 - stay)).ravel())
        m[np.arange(n), np.arange(n)] += np.where(total > 0, stay, 1.0)
        return m

    def step(self, cell: np.ndarray, heading: np.ndarray, goal: np.ndarray | None, model: BeliefModel, draw: np.ndarray, strides: Strides | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """One step of every walker: a neighbour by weight, more likely on the old heading and towards the goal, whose
        ``strides`` are used where there are any; ``first`` are the rows at which these begin, if ``goal`` isn't given. It is
        looked up in the ``guide``, and worked out for draws that it leaves open."""
        if strides is not None and first is None:
            first = strides.first.take(goal)
        guide = self.guide(model, strides) if goal is None or strides is not None else None
        if guide is None:
            w = self.weight.take(cell, 0) if first is None else strides.weight.take(first + cell, 0)
            if model.persistence:
                w *= self._boost(model).take(heading, 0)
            if first is None:
                w *= 1 if goal is None else self.pull(model.goal_beta).take(self.way(cell, goal), 0)
            for m in range(1, 8):
                w[:, m] += w[:, m - 1]
            pick = self._picked(w, draw, model)
            return self.to_or_stay.take(cell * (STAY + 1) + pick), pick
        here = cell * (STAY + 1)
        row = here + heading if first is None else (first + cell) * (STAY + 1) + heading
        at = row * PARTS
        at += (draw * PARTS).astype(np.int64)
        pick = guide[0].take(at)
        unsure = (pick == UNSURE).nonzero()[0]
        pick = pick.astype(np.int64)
        if len(unsure):
            pick[unsure] = self._picked(guide[1].take(row.take(unsure), 0), draw.take(unsure), model)
        here += pick
        return self.to_or_stay.take(here), pick

    @staticmethod
    def _picked(upto: np.ndarray, draw: np.ndarray, model: BeliefModel) -> np.ndarray:
        """The move of every walker, by the sums of the moves' weights."""
        # Cells without a way out have no weights, and every draw is at or above them.
        above = draw * (upto[:, -1] / (1 - model.stay))
        return np.bitwise_count((above[:, None] >= upto).view(np.uint64)).ravel().astype(np.int64)


class Sight:
    """Where sources see: the cells around each source that it lights, worked out once for all of them.

    A cell has nine points, its middle and eight on the ring around it, and one bit for each.
    """

    def __init__(self, ground: Ground, x: np.ndarray, z: np.ndarray, r: np.ndarray, model: BeliefModel):
        self.side, n = ground.side, len(x)
        points = [(0, 0), *MOVES.tolist()]
        middle = (np.arange(ground.side) + 0.5) * ground.cell
        whole = ground.side * ground.cell
        # Off the map counts as lit.
        off = lambda d: ((v := middle + d * model.ring) < 0) | (v >= whole)
        self.beyond = np.zeros((ground.side, ground.side), np.int16)
        for bit, (di, dj) in enumerate(points):
            self.beyond |= (off(di)[:, None] | off(dj)[None]).astype(np.int16) << bit
        seen = np.arange(1 << len(points))
        self.chance = np.where(seen & 1, np.where(seen == (1 << len(points)) - 1, model.inside, model.edge), 0.0)
        self.window: list[tuple[slice, slice] | None] = [None] * n
        self.bits: list[np.ndarray | None] = [None] * n
        real = np.flatnonzero(~(np.isnan(x) | np.isnan(z) | np.isnan(r)))
        reach = (np.abs(r[real]) + abs(model.ring)) / ground.cell
        size = np.minimum(2 * np.ceil(np.minimum(reach, ground.side)).astype(np.int64) + 2, ground.side)
        low = lambda v, width: np.clip(np.floor(v / ground.cell - reach) - 0.0, 0, ground.side - width).astype(np.int64)
        first_i, first_j = low(x[real], size), low(z[real], size)
        for width in np.unique(size):
            every = np.flatnonzero(size == width)
            step = max(1, (1 << 20) // int(width) ** 2)
            for at in (every[k : k + step] for k in range(0, len(every), step)):
                source, span = real[at], np.arange(width)
                a, b = middle[first_i[at][:, None] + span], middle[first_j[at][:, None] + span]
                dx = {d: (a + d * model.ring - x[source][:, None]) ** 2 for d in (-1, 0, 1)}
                dz = {d: (b + d * model.ring - z[source][:, None]) ** 2 for d in (-1, 0, 1)}
                rr = (r[source] * r[source])[:, None, None]
                bits = np.zeros((len(at), width, width), np.int16)
                for bit, (di, dj) in enumerate(points):
                    bits |= (dx[di][:, :, None] + dz[dj][:, None] <= rr).astype(np.int16) << bit
                for k, s, i, j in zip(range(len(at)), source.tolist(), first_i[at].tolist(), first_j[at].tolist()):
                    self.window[s], self.bits[s] = (slice(i, i + int(width)), slice(j, j + int(width))), bits[k]

    def detection(self, sources: np.ndarray | list[int]) -> np.ndarray:
        """Chance, for each cell, that a hero in its middle is seen by these sources; see ``detection``."""
        lit = self.beyond.copy()
        for s in sources:
            if self.window[s] is not None:
                lit[self.window[s]] |= self.bits[s]
        return self.chance.take(lit).ravel()


def detection(ground: Ground, x: np.ndarray, z: np.ndarray, r: np.ndarray, model: BeliefModel) -> np.ndarray:
    """Chance, for each cell, that a hero in its middle is seen by sources at (x, z) with radius r: ``inside`` where eight
    points on the ring around it are lit, too, ``edge`` where one isn't; off the map counts as lit."""
    if not len(x):
        return np.zeros(ground.side**2)
    return Sight(ground, x, z, r, model).detection(range(len(x)))


def normalised(logw: np.ndarray) -> np.ndarray:
    """Log-weights of each row as weights with the sum 1; equal where none is finite."""
    top = logw.max(1, keepdims=True)
    w = np.where(np.isfinite(top), np.exp(logw - np.where(np.isfinite(top), top, 0.0)), 1.0)
    return w / w.sum(1, keepdims=True)


class Histogram:
    """Weighted particles as probabilities of the LATTICE x LATTICE bins; bins without open ground get none."""

    def __init__(self, ground: Ground, smoothing: float):
        i, j = np.divmod(np.arange(ground.side**2), ground.side)
        self.bin_of = (i * LATTICE // ground.side) * LATTICE + j * LATTICE // ground.side
        self.open = np.bincount(self.bin_of[ground.open], minlength=LATTICE**2) > 0
        self.smoothing = smoothing

    def __call__(self, cell: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """[row, bin] for cells and weights of [row, particle]."""
        n = len(cell)
        at = self.bin_of[cell] + np.arange(n)[:, None] * LATTICE**2
        h = np.bincount(at.ravel(), weight.ravel(), n * LATTICE**2).reshape(n, LATTICE, LATTICE)
        pad = np.zeros((n, LATTICE + 2, LATTICE + 2))
        pad[:, 1:-1, 1:-1] = h
        around = np.zeros_like(h)
        for a, b in MOVES.tolist():
            around += pad[:, 1 + a : 1 + a + LATTICE, 1 + b : 1 + b + LATTICE]
        h *= 1 - self.smoothing
        around *= self.smoothing / 8
        h += around
        h = h.reshape(n, -1)
        h *= self.open
        total = h.sum(1, keepdims=True)
        if (total > 0).all():
            h /= total
            return h
        return np.where(total > 0, h / np.where(total > 0, total, 1.0), self.open / max(1, self.open.sum()))


class Filters:
    """The filters of several heroes with one model, side by side."""

    def __init__(self, ground: Ground, model: BeliefModel, home: np.ndarray, goals: list[np.ndarray], tick_s: float, rng: np.random.Generator):
        """``home``: the cell of each hero's fountain; ``goals``: the cells that each may walk to."""
        n, p = len(home), model.particles
        self.ground, self.model, self.home, self.goals, self.tick_s, self.rng = ground, model, home, goals, tick_s, rng
        self.cell = np.tile(home[:, None], (1, p))
        self.logw, self.heading, self.goal = np.zeros((n, p)), np.full((n, p), STAY), self.cell.copy()
        self.place = np.stack([self.cell // ground.side, self.cell % ground.side], 2) + 0.5
        self.velocity, self.last, self.last_tick, self.alive = np.zeros((n, 2)), home.copy(), np.zeros(n, np.int64), np.ones(n, bool)
        self.strides = ground.prepare(np.concatenate([home, *goals]), model) if model.motion == "behavioural" else None
        if self.strides is not None:
            # Goals are then known by the rows at which their strides begin.
            self.goal, self.goals = self.strides.first.take(self.goal), [self.strides.first.take(g) for g in goals]
        #: ``logw`` as weights with the sum 1.
        self.even = normalised(np.zeros((1, p)))[0]
        self.weight, self.is_even = np.tile(self.even, (n, 1)), np.ones(n, bool)
        self.n_resampled = self.n_depleted = 0

    def _put(self, h: int | np.ndarray, cells: np.ndarray | int) -> None:
        """Places the particles of one hero, or of several with ``cells`` of [hero, 1 or particle]."""
        self.cell[h], self.heading[h] = cells, STAY
        self._evened(h)
        if self.model.motion == "constant":
            self.place[h] = np.stack(np.divmod(cells, self.ground.side), -1) + 0.5

    def _evened(self, h: int | np.ndarray) -> None:
        """Makes the weights equal, where they aren't."""
        some = np.atleast_1d(h)
        some = some[~self.is_even[some]]
        if len(some):
            self.logw[some], self.weight[some], self.is_even[some] = 0.0, self.even, True

    def _move(self, moving: np.ndarray, tick: int, found: np.ndarray) -> None:
        """Moves particles; those of a hero that is ``found`` at this tick are placed anew, so that only draws are made for it."""
        model, ground, rng, p = self.model, self.ground, self.rng, self.model.particles
        if model.motion in ("diffusion", "behavioural"):
            every = len(moving) == len(self.cell)
            of = lambda state: state.ravel() if every else state[moving].ravel()
            goal = first = None
            if model.motion == "behavioural":
                cell, goal = of(self.cell), of(self.goal)
                close = ground.close(model.arrive).take(ground.way(cell, goal)) if self.strides is None else self.strides.close.take(goal + cell)
                arrived = close.nonzero()[0]
                if len(arrived):
                    for h, n in zip(moving, np.bincount(arrived // p, minlength=len(moving)).tolist()):
                        if n:
                            ours, arrived = arrived[:n], arrived[n:]
                            goal[ours] = self.goals[h][rng.integers(0, len(self.goals[h]), n)]
                    if not every:
                        self.goal[moving] = goal.reshape(-1, p)
            draws = [rng.random(len(moving) * p) for _ in range(model.sub_steps)]
            lost = ~found[moving]
            if not lost.all():
                every, moving, draws = False, moving[lost], [d.reshape(-1, p)[lost].ravel() for d in draws]
                goal = None if goal is None else goal.reshape(-1, p)[lost].ravel()
            if not len(moving):
                return
            if self.strides is not None:
                goal, first = None, goal
            cell, heading = of(self.cell), of(self.heading)
            for draw in draws:
                cell, heading = ground.step(cell, heading, goal, model, draw, self.strides, first)
            self.cell[moving], self.heading[moving] = cell.reshape(-1, p), heading.reshape(-1, p)
            return
        if model.motion == "constant":
            # Spread per second of 28.5 units, more the longer ago the hero was seen.
            noise = rng.standard_normal((len(moving), p, 2))
            lost = ~found[moving]
            moving, noise = moving[lost], noise[lost]
            elapsed = np.maximum(0, tick - self.last_tick[moving]) * self.tick_s
            noise *= (28.5 / ground.cell * (1 + elapsed) * np.sqrt(self.tick_s))[:, None, None]
            place = self.place[moving] + self.velocity[moving][:, None]
            place += noise
            self.place[moving] = np.clip(place, 0, ground.side - 1e-6, out=place)
            at = place.astype(np.int64)
            self.cell[moving] = at[:, :, 0] * ground.side + at[:, :, 1]
            return
        for h in moving:
            elapsed = max(0, tick - self.last_tick[h]) * self.tick_s
            if model.motion == "uniform":
                self.cell[h] = ground.open[rng.integers(0, len(ground.open), p)]
            elif model.motion == "geodisc":
                cells = ground.within(int(self.last[h]), model.fastest * elapsed)
                self.cell[h] = cells[rng.integers(0, len(cells), p)]
            else:
                angle, r = rng.uniform(0, 2 * np.pi, p), model.fastest * elapsed * np.sqrt(rng.random(p))
                if found[h]:
                    continue
                i, j = (np.array(divmod(int(self.last[h]), ground.side)) + 0.5) * ground.cell
                self.cell[h] = ground.cell_of(np.clip(i + r * np.cos(angle), 0, None), np.clip(j + r * np.sin(angle), 0, None))

    def tick(self, tick: int, alive: np.ndarray, seen: np.ndarray, observed: np.ndarray, pd: np.ndarray, row: np.ndarray | None = None) -> None:
        """One tick: ``seen`` at cell ``observed`` (-1: not known), ``pd`` [hero, cell] the chance of being seen; with ``row``,
        that of each hero is in this row of it."""
        model, ground = self.model, self.ground
        row = np.arange(len(alive)) if row is None else row
        found = alive & seen & (observed >= 0) & model.positive
        for h in np.flatnonzero(~alive):
            self._put(h, self.last[h])
        for h in np.flatnonzero(alive & ~self.alive):
            self._put(h, self.home[h])
            self.last[h], self.last_tick[h] = self.home[h], tick
        self.alive = alive.copy()
        moving = np.flatnonzero(alive)
        if len(moving):
            self._move(moving, tick, found)
        sighted = np.flatnonzero(found)
        if len(sighted):
            now = observed[sighted]
            if model.motion == "constant":
                gap = tick - self.last_tick[sighted]
                near = (gap > 0) & (gap * self.tick_s <= 1.0)
                h, gap, way = sighted[near], gap[near], np.stack(np.divmod(now[near], ground.side)) - np.stack(np.divmod(self.last[sighted[near]], ground.side))
                self.velocity[h] = (way / gap).T
            self._put(sighted, now[:, None])
            self.last[sighted], self.last_tick[sighted] = now, tick
        if not model.negative:
            return
        hidden = np.flatnonzero(alive & ~seen)
        if not len(hidden):
            return
        # Where no particle is in sight, weights stay as they are, and they were drawn anew if they had to be.
        unseen, lit = np.zeros(pd.size), np.flatnonzero(pd)
        with np.errstate(divide="ignore"):
            unseen[lit] = np.log1p(-pd.ravel()[lit])
        unseen = unseen.take((row[hidden] * pd.shape[1])[:, None] + self.cell[hidden])
        hit = unseen.any(1)
        hidden, unseen = hidden[hit], unseen[hit]
        if not len(hidden):
            return
        self.logw[hidden] += unseen
        w = self.weight[hidden] = normalised(self.logw[hidden])
        self.is_even[hidden] = False
        alive_mass = np.isfinite(self.logw[hidden].max(1))
        size = np.where(alive_mass, 1 / (w * w).sum(1), 0.0)
        for h, ess, weight in zip(hidden, size, w):
            if ess < model.deplete * model.particles:
                cells = ground.within(int(self.last[h]), model.fastest * max(tick - self.last_tick[h], 1) * self.tick_s)
                dark = cells[pd[row[h], cells] == 0]
                dark = dark if len(dark) else cells
                self._put(h, dark[self.rng.integers(0, len(dark), model.particles)])
                self.n_depleted += 1
            elif ess < model.resample * model.particles:
                # Systematic resampling: one draw, as many strata as particles.
                pick = np.minimum(np.searchsorted(np.cumsum(weight), (self.rng.random() + np.arange(model.particles)) / model.particles), model.particles - 1)
                for state in (self.cell, self.heading, self.goal, *([self.place] if model.motion == "constant" else [])):
                    state[h] = state[h, pick]
                self._evened(h)
                self.n_resampled += 1
