import itertools
import random

from mistrail.llm.packing import _Sizes, best_fit, fillings, pack_items, pack_sizes


def optimum(capacity, sizes):
    """Least number of containers by trying every assignment."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k]:
                rooms[i] -= sizes[k]
                place(k + 1, rooms)
                rooms[i] += sizes[k]
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_finds_the_optimum_on_small_instances():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([10, 30, 100])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        packed = pack_sizes(capacity, sizes)
        assert sorted(itertools.chain(*packed), reverse=True) == sizes
        assert all(sum(c) <= capacity for c in packed)
        assert len(packed) == optimum(capacity, sizes)


def by_subsets(capacity, sizes):
    """Least number of containers by dynamic programming over the subsets: fewest containers, then least in the last one."""
    best = [(0, capacity)] + [(len(sizes) + 1, 0)] * ((1 << len(sizes)) - 1)
    for done in range(1 << len(sizes)):
        n, last = best[done]
        for k, s in enumerate(sizes):
            if not done >> k & 1:
                best[done | 1 << k] = min(best[done | 1 << k], (n, last + s) if last + s <= capacity else (n + 1, s))
    return best[-1][0]


def test_finds_the_optimum_where_best_fit_does_not():
    assert len(pack_sizes(100, [53, 55, 37, 31, 39, 26, 16, 33, 37, 52])) == 4
    rng, better = random.Random(6), 0
    for _ in range(150):
        sizes = [rng.randint(15, 60) for _ in range(rng.randint(10, 12))]
        packed = pack_sizes(100, sizes)
        assert sorted(itertools.chain(*packed)) == sorted(sizes) and all(sum(c) <= 100 for c in packed)
        assert len(packed) == by_subsets(100, sizes)
        better += len(packed) < len(best_fit(100, sizes))
    assert better > 5


def test_containers_that_can_be_full_are_found():
    rng, better = random.Random(8), 0
    for _ in range(40):
        sizes = []
        for _ in range(6):
            cuts = sorted(rng.sample(range(1, 100), 2))
            sizes += [cuts[0], cuts[1] - cuts[0], 100 - cuts[1]]
        assert len(pack_sizes(100, sizes, nodes=None)) == 6
        better += len(best_fit(100, sizes)) > 6
    assert better > 5


def brute_fillings(sizes, room, waste):
    """Undominated fillings by the definition: their items don't fit into those of another one as into containers."""
    sets = {tuple(sorted(c, reverse=True)) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= room}

    def into(items, rooms):
        return not items or any(r >= items[0] and into(items[1:], [*rooms[:i], r - items[0], *rooms[i + 1 :]]) for i, r in enumerate(rooms))

    return {f for f in sets if sum(f) >= room - waste and not any(g != f and into(f, list(g)) for g in sets)}


def test_fillings_are_all_undominated_ones():
    rng = random.Random(7)
    for _ in range(60):
        sizes = [rng.randint(1, 14) for _ in range(rng.randint(0, 7))]
        room, waste = rng.randint(1, 25), rng.randint(0, 12)
        left = _Sizes(30, sizes)
        got = [f for f, good in fillings(left, room, waste) if good]
        assert len(set(got)) == len(got) and set(got) == brute_fillings(sizes, room, waste)
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_beats_best_fit_where_that_is_wrong():
    sizes = [6, 5, 4, 4, 3, 3, 3, 2] * 2
    assert len(pack_sizes(15, sizes)) <= len(best_fit(15, sizes))
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 2
    assert len(pack_sizes(61, sizes)) <= len(best_fit(61, sizes))


def test_hard_sums_end():
    """Even sizes and an odd capacity, many equal small items, and sizes of which nothing full can be made."""
    rng = random.Random(10)
    for sizes, capacity in (([2 * rng.randint(100, 500) for _ in range(400)], 2047), ([1] * 5000, 2048), ([rng.randint(683, 1100) for _ in range(500)], 2048), ([7] * 300 + [11] * 300 + [1500] * 90, 2048)):
        packed = pack_sizes(capacity, sizes)
        assert sorted(itertools.chain(*packed)) == sorted(sizes) and all(sum(c) <= capacity for c in packed) and len(packed) <= len(best_fit(capacity, sizes))


def test_large_group_is_nearly_full():
    rng = random.Random(9)
    sizes = [rng.randint(1, 2048) for _ in range(3000)]
    packed = pack_sizes(2048, sizes)
    assert len(packed) <= -(-sum(sizes) // 2048) * 1.02 + 1


def test_items(spark):
    rows = [(1, 5000), (2, 0), (3, None), (4, 2048), (5, 2049), (6, 10), (6, 10), (None, 7)]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc long, n long, container long")
    got = pack_items(df, "doc", "n", 2048).collect()
    per_doc, fill = {}, {}
    for r in got:
        per_doc.setdefault(r.doc_id, []).append(r)
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert {k: sum(r.tokens for r in v) for k, v in per_doc.items()} == {1: 5000, 2: 0, 3: 0, 4: 2048, 5: 2049, 6: 20, None: 7}
    assert max(fill.values()) <= 2048
    assert {k for k, v in per_doc.items() if len({r.container for r in v}) > 1 and k != 6} == {1, 5}
    assert len(pack_items(df, "doc", "n", 2048, group_items=2).collect()) == len(got)
    assert pack_items(df.limit(0), "doc", "n", 2048).collect() == []
