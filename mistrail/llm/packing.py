"""Texts into containers of fixed capacity: bin completion by branch and bound."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one group; each group is packed by itself and wastes at most about one container.
GROUP_ITEMS = 8192
#: Nodes of the search tree after which a group keeps the best packing found so far.
NODES = 20_000


class _Sizes:
    """How many items of each size are left, with the sizes that occur as the bits of a number."""

    def __init__(self, capacity: int, sizes: list[int]):
        self.capacity, self.count = capacity, [0] * (capacity + 1)
        self.up = 0
        for s in sizes:
            self.add(s)

    def add(self, s: int) -> None:
        if not self.count[s]:
            self.up |= 1 << s
        self.count[s] += 1

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.up &= ~(1 << s)

    def largest(self, most: int) -> int:
        """The largest size of at most ``most`` that is left, 0 if there is none."""
        return (self.up & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.up & ((2 << most) - 1) else 0


class _Sums:
    """Ways to make a sum of the items left: sizes that don't grow, those with the largest items first.

    The sums that can't be made are remembered; after STUCK of them all that can be made of the items up to each size
    are worked out, as the bits of a number, and nothing that can't is tried.
    """

    STUCK = 200

    def __init__(self, left: _Sizes, room: int):
        self.left, self.room = left, room
        self.dead: set[tuple[int, int]] = set()
        self.reach: dict[int, int] = {}

    def _reachable(self) -> dict[int, int]:
        bits, within, size = 1, (2 << self.room) - 1, 0
        up = self.left.up & within
        while up := up >> size + 1 << size + 1:
            size = (up & -up).bit_length() - 1
            for _ in range(min(self.left.count[size], self.room // size)):
                bits |= bits << size & within
            self.reach[size] = bits
        return self.reach

    def make(self, rest: int, most: int) -> Iterator[tuple[int, ...]]:
        """``rest`` of items of at most ``most``."""
        if not rest:
            yield ()
            return
        first = size = self.left.largest(min(rest, most))
        made = False
        while size and (rest, size) not in self.dead:
            if self.reach and not self.reach[size] >> rest & 1:
                break
            for n in range(min(self.left.count[size], rest // size), 0, -1):
                for tail in self.make(rest - n * size, size - 1):
                    made = True
                    yield (size,) * n + tail
            size = self.left.largest(size - 1)
        if first and not made:
            self.dead.add((rest, first))
            if len(self.dead) == self.STUCK:
                self._reachable()


def undominated(left: _Sizes, filling: tuple[int, ...], room: int) -> bool:
    """Whether no item that is left could take the place of some of the filling's items, of no more than its own size.

    If a filling is dominated at all (its items fit into those of another one as into containers), one such exchange of
    a subset for a single item that still fits exists. Sums of subsets are the bits of a number.
    """
    one, two = 0, 0
    for s in filling:
        two |= (two << s) | (one << s)
        one |= 1 << s
    rest = room - sum(filling)
    others = left.up
    for s in set(filling):
        if left.count[s] == filling.count(s):
            others &= ~(1 << s)
    # A sum of several items may be exchanged for an item from that sum on, a single item or none for a larger one.
    reach = two | ((one | two | 1) << 1 if rest else 0)
    width = 1
    while width < rest:
        step = min(width, rest - width)
        reach |= reach << step
        width += step
    return not reach & others


def fillings(left: _Sizes, room: int, waste: int) -> Iterator[tuple[tuple[int, ...], bool]]:
    """Every filling of ``room`` with at most ``waste`` left over, least left over first, one at a time, and whether it is
    undominated.

    ``left`` may change between two of them, but must be as it was when the next one is asked for.
    """
    sums = _Sums(left, room)
    for total in range(room, max(0, room - waste) - 1, -1):
        for filling in sums.make(total, total):
            yield filling, undominated(left, filling, room)


def best_fit(capacity: int, sizes: list[int]) -> list[list[int]]:
    """Best-fit decreasing: each item, the largest first, into the fullest container that takes it."""
    room = _Sizes(capacity, [])
    by_room: dict[int, list[int]] = {}
    containers: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        fits = room.up >> s << s
        if fits:
            r = (fits & -fits).bit_length() - 1
            room.take(r)
            number = by_room[r].pop()
        else:
            r, number = capacity, len(containers)
            containers.append([])
        containers[number].append(s)
        if r - s:
            room.add(r - s)
            by_room.setdefault(r - s, []).append(number)
    return containers


def pack_sizes(capacity: int, sizes: list[int], nodes: int | None = NODES) -> list[list[int]]:
    """Containers, as lists of sizes from 1 to ``capacity``, with as little room left over as the search finds.

    Bin completion: the largest item left opens a container and each undominated filling around it is a branch, the
    fullest first. A branch is pruned once the room wasted so far leaves no way to use fewer containers than the best
    packing found, the incumbent; the first incumbent is the best-fit packing. The search ends at the lower bound (all
    sizes over the capacity), once all branches are done, which proves the best packing, or after ``nodes`` fillings
    looked at; None sets no such end.
    """
    best = best_fit(capacity, sizes)
    total = sum(sizes)
    bound = -(-total // capacity)
    if len(best) <= bound:
        return best
    left = _Sizes(capacity, sizes)
    allowed = (len(best) - 1) * capacity - total
    #: Open containers: largest item, fillings to come, room wasted before, filling chosen.
    path: list[list] = []
    wasted, spent = 0, 0

    def branch() -> None:
        big = left.largest(capacity)
        left.take(big)
        path.append([big, fillings(left, capacity - big, allowed - wasted), wasted, None])

    branch()
    while path and (nodes is None or spent < nodes):
        frame = path[-1]
        big, options, before, chosen = frame
        if chosen is not None:
            for s in chosen:
                left.add(s)
            frame[3] = None
        wasted = before
        option, good = next(options, (None, False))
        spent += 1
        if option is None or before + capacity - big - sum(option) > allowed:
            # Later ones waste as much or more.
            left.add(big)
            path.pop()
            continue
        if not good:
            continue
        for s in option:
            left.take(s)
        frame[3] = option
        wasted = before + capacity - big - sum(option)
        if left.up:
            branch()
            continue
        best = [[b, *o] for b, _, _, o in path]
        allowed = (len(best) - 1) * capacity - total
        if len(best) <= bound:
            break
    return best


def pack_items(items: DataFrame, item_id: str, size: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(doc_id, piece_no, container, tokens): each item in containers of ``capacity``.

    An item above the capacity fills containers of its own, and what is left of it is packed like any other item; no
    other item is divided. ``container`` numbers them uniquely, not without gaps.

    Items are dealt by hash of id and row into groups of about ``group_items``, and every group is packed by itself, by bin completion;
    a group has the sizes of the whole, so that it wastes at most about one container more than the whole would.

    Defined results: items of size 0 (missing texts) or of null size take no room and lie in a container of their group;
    repeated and null ids are items of their own, and spread like any others; no items give no rows.
    """
    rows = items.select(F.col(item_id).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    groups = max(1, math.ceil(items.count() / group_items))
    dealt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)).cast("int")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        base = int(frame["group"].iloc[0]) << 32
        frame = frame.sort_values(["doc_id", "size"], kind="stable")
        out: list[tuple[int | None, int, int, int]] = []
        waiting: dict[int, list[tuple[int | None, int]]] = {}
        nothing, number = [], 0
        for doc, tokens in zip(frame["doc_id"].tolist(), frame["size"].tolist()):
            doc = None if pd.isna(doc) else int(doc)
            full, rest = divmod(tokens, capacity)
            for piece in range(full):
                out.append((doc, piece, base + number, capacity))
                number += 1
            if rest:
                waiting.setdefault(rest, []).append((doc, full))
            elif not full:
                nothing.append(doc)
        for container in pack_sizes(capacity, [s for s, docs in waiting.items() for _ in docs]):
            for s in container:
                doc, piece = waiting[s].pop()
                out.append((doc, piece, base + number, s))
            number += 1
        out.extend((doc, 0, base, 0) for doc in nothing)
        return pd.DataFrame(out, columns=["doc_id", "piece_no", "container", "tokens"]).astype({"doc_id": "Int64"})

    # As many partitions as groups, which adaptive execution doesn't bring together: packing takes time, not bytes.
    return rows.withColumn("group", dealt).repartition(groups, "group").groupBy("group").applyInPandas(pack, "doc_id long, piece_no int, container long, tokens long")
