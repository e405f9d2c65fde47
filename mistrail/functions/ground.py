"""Small kernels on a raster of ground: sight, connected cells, distances along open cells."""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np

#: Length of a step to a neighbour across an edge and across a corner, in 70ths of a cell.
STEP, CORNER = 70, 99


@dataclass(frozen=True)
class Raster:
    """A square of cells, by [i, j]: whether they can be walked on, whether they block sight, and their patch of brush (-1: none)."""

    open: np.ndarray
    blocks: np.ndarray
    brush: np.ndarray

    @property
    def side(self) -> int:
        return len(self.open)


@lru_cache(8)
def _sweep(reach: int) -> tuple[int, list[list[tuple[int, int, int]]]]:
    """The directions of an octant, cut where a cell of it begins or ends: how many parts there are, and for each distance
    its cells (c, a, b), which take up the parts a..b-1."""
    low = lambda d, c: max(Fraction(2 * c - 1, 2 * d + 1), Fraction(0))
    high = lambda d, c: min(Fraction(2 * c + 1, 2 * d - 1), Fraction(1))
    cells = [(d, c) for d in range(1, reach + 1) for c in range(d + 1)]
    cuts = sorted({edge(d, c) for d, c in cells for edge in (low, high)})
    number = {cut: k for k, cut in enumerate(cuts)}
    rows = [[(c, number[low(d, c)], number[high(d, c)]) for c in range(d + 1)] for d in range(1, reach + 1)]
    return len(cuts) - 1, rows


def fields_of_view(raster: Raster, i: np.ndarray, j: np.ndarray, brush: np.ndarray, radius: float) -> np.ndarray:
    """What is seen from the middle of each cell (i, j) within ``radius`` cells: [source, i - reach..i + reach, j - reach..].

    Octants are swept outward, all sources at once: a cell is seen if some direction through it isn't taken by a nearer
    cell that blocks sight, and takes all directions through it if it blocks sight itself. Walls block and can be seen;
    brush other than the source's own blocks and can't; nothing is seen off the raster.
    """
    reach = int(radius)
    n, side = len(i), raster.side
    pad = lambda a, v: np.pad(a, reach, constant_values=v)
    blocks, patch, inside = pad(raster.blocks, True), pad(raster.brush, -1), pad(np.ones((side, side), bool), False)
    seen = np.zeros((n, 2 * reach + 1, 2 * reach + 1), bool)
    seen[:, reach, reach] = True
    n_parts, rows = _sweep(reach)
    for swap in (False, True):
        for si in (1, -1):
            for sj in (1, -1):
                taken = np.zeros((n, n_parts), bool)
                for d, row in enumerate(rows, 1):
                    after = []
                    for c, a, b in row:
                        di, dj = (c * si, d * sj) if swap else (d * si, c * sj)
                        x, z = i + reach + di, j + reach + dj
                        foreign = (patch[x, z] >= 0) & (patch[x, z] != brush)
                        if d * d + c * c <= radius * radius:
                            seen[:, reach + di, reach + dj] |= ~taken[:, a:b].all(1) & inside[x, z] & ~foreign
                        stops = np.flatnonzero(blocks[x, z] | foreign)
                        if len(stops):
                            after.append((stops, a, b))
                    for stops, a, b in after:
                        taken[stops, a:b] = True
    return seen


def packed(seen: np.ndarray) -> np.ndarray:
    """Windows as words of 64 bits, row by row; a row begins with a new word."""
    n, rows, width = seen.shape
    words = -(-width // 64)
    bits = np.zeros((n, rows, words * 64), np.uint8)
    bits[:, :, :width] = seen
    return np.packbits(bits, axis=2, bitorder="little").view("<i8").reshape(n, rows * words)


def components(on: np.ndarray) -> np.ndarray:
    """For each cell that is on, the least index (i * side + j) among the cells on that it is connected with over edges and
    corners; -1 for the others."""
    side = on.shape[1]
    label = np.where(on, np.arange(on.size).reshape(on.shape), on.size)
    while True:
        padded = np.pad(label, 1, constant_values=on.size)
        least = np.minimum.reduce([padded[1 + a : 1 + a + on.shape[0], 1 + b : 1 + b + side] for a in (-1, 0, 1) for b in (-1, 0, 1)])
        least = np.where(on, least, on.size)
        # A label is a cell, too: it takes that cell's label on.
        flat = np.append(least.ravel(), on.size)
        least = np.minimum(least, flat[least])
        if (least == label).all():
            return np.where(on, label, -1)
        label = least


def walk_distances(open_cells: np.ndarray, i: int, j: int) -> np.ndarray:
    """Length of the shortest walk from (i, j) to each open cell in 70ths of a cell, -1 where there is none. A step across a
    corner needs both cells beside it open."""
    side_i, side_j = open_cells.shape
    far = np.full(open_cells.shape, -1, np.int64)
    if not open_cells[i, j]:
        return far
    best = {(i, j): 0}
    heap = [(0, i, j)]
    while heap:
        d, i, j = heapq.heappop(heap)
        if far[i, j] >= 0:
            continue
        far[i, j] = d
        for di in (-1, 0, 1):
            for dj in (-1, 0, 1):
                a, b = i + di, j + dj
                if not (0 <= a < side_i and 0 <= b < side_j) or far[a, b] >= 0 or not open_cells[a, b] or not (open_cells[a, j] and open_cells[i, b]):
                    continue
                way = d + (CORNER if di and dj else STEP)
                if way < best.get((a, b), way + 1):
                    best[a, b] = way
                    heapq.heappush(heap, (way, a, b))
    return far


def walks_within(open_cells: np.ndarray, i: int, j: int, most: int) -> tuple[np.ndarray, int, int]:
    """``walk_distances`` up to ``most``, of a window of the raster, and the window's first row and column.

    All cells of the window at once, until none can be reached by a shorter walk.
    """
    reach = most // STEP + 1
    low_i, low_j = max(0, i - reach), max(0, j - reach)
    window = open_cells[low_i : i + reach + 1, low_j : j + reach + 1]
    pad = np.pad(window, 1)
    rows, columns = window.shape
    moves = []
    for di in (-1, 0, 1):
        for dj in (-1, 0, 1):
            if di or dj:
                at = lambda a, b: pad[1 + a : 1 + a + rows, 1 + b : 1 + b + columns]
                free = at(di, dj) & at(di, 0) & at(0, dj) & window
                moves.append((di, dj, np.where(free, CORNER if di and dj else STEP, most + 1).astype(np.int32)))
    far = np.full((rows + 2, columns + 2), most + 1, np.int32)
    inner = far[1:-1, 1:-1]
    if window[i - low_i, j - low_j]:
        inner[i - low_i, j - low_j] = 0
    while True:
        before = inner.copy()
        for di, dj, cost in moves:
            np.minimum(inner, far[1 + di : 1 + di + rows, 1 + dj : 1 + dj + columns] + cost, out=inner)
        if (before == inner).all():
            return np.where(inner <= most, inner, -1).astype(np.int64), low_i, low_j


def walks_from(open_cells: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``walk_distances`` over the whole raster, by [start, cell], from several open cells at once.

    Cells are settled by their distance in STEPs: as no step is shorter, none of those settled together is nearer through
    another of them.
    """
    side_i, side_j = open_cells.shape
    n = side_i * side_j
    i, j = np.divmod(np.arange(n), side_j)
    pad = np.pad(open_cells, 1)
    moves = []
    for di in (-1, 0, 1):
        for dj in (-1, 0, 1):
            if di or dj:
                free = pad[i + 1 + di, j + 1 + dj] & pad[i + 1 + di, j + 1] & pad[i + 1, j + 1 + dj]
                moves.append((di * side_j + dj, CORNER if di and dj else STEP, free))
    unknown = np.iinfo(np.int32).max
    far = np.full(len(starts) * n, unknown, np.int32)
    mark = np.empty(len(far), np.int32)
    front = np.arange(len(starts)) * n + starts
    far[front] = 0
    later: dict[int, list[np.ndarray]] = {0: [front]}
    level = 0
    while later:
        found = later.pop(level, [])
        if found:
            at = np.concatenate(found)
            at = at[far[at] // STEP == level]
            mark[at] = np.arange(len(at))
            at = at[mark[at] == np.arange(len(at))]
            cell = at % n
            for to, cost, free in moves:
                here = at[free[cell]]
                there, way = here + to, far[here] + cost
                nearer = way < far[there]
                there, way = there[nearer], way[nearer]
                far[there] = way
                step = way // STEP
                for up in range(level + 1, level + 1 + -(-CORNER // STEP)):
                    if len(some := there[step == up]):
                        later.setdefault(up, []).append(some)
        level += 1
    return np.where(far == unknown, -1, far).astype(np.int64).reshape(len(starts), n)
