"""Forests by pointer doubling against walks, with chains, stars, cycles and dangling rows."""

import random

from palimpsest.operators import trees

SCHEMA = "history_name string, memory_id long, parent_primary long, memory_role string, size long"


def walked(rows):
    """Pre-order by recursion on a stack: places, depths, sizes and packages."""
    out, packages = {}, []
    for h in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == h]
        ids = {r[1] for r in mine}
        kids: dict = {}
        roots = sorted(r[1] for r in mine if r[2] is None and r[3] is None)
        for r in mine:
            if h is not None and r[2] in ids:
                kids.setdefault(r[2], []).append(r[1])
        order, stack = [], [(r, r, 0, None) for r in reversed(roots)]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += [(k, node[1], node[2] + 1, node[0]) for k in sorted(kids.get(node[0], ()), reverse=True)]
        size = {i: 1 for i, _, _, _ in order}
        for i, _, _, parent in reversed(order):
            if parent is not None:
                size[parent] += size[i]
        out |= {(h, i): (root, d, size[i], place) for place, (i, root, d, _) in enumerate(order)}
        mine = [(h, i, d, [i, *sorted(k for k in kids.get(i, ()) if k not in kids)]) for i, _, d, _ in order if d == 0 or i in kids]
        packages += [(h, place + 1, i, d, members) for place, (_, i, d, members) in enumerate(mine)]
    return out, packages


def forest():
    r = random.Random(4)
    rows = [("deep", i, None if i == 1 else i - 1, None if i == 1 else "evidence", 9) for i in range(1, 200)]
    rows += [("star", i, None if i == 5 else 5, None if i == 5 else "evidence", 9) for i in range(1, 80)]
    for i in range(150):
        parent = r.choice([None, *range(max(0, i - 9), i)]) if i else None
        rows.append(("mixed", i, parent, None if parent is None else "evidence", 9))
    rows += [("odd", 1, 2, "evidence", 9), ("odd", 2, 3, "evidence", 9), ("odd", 3, 1, "evidence", 9), ("odd", 4, 3, "evidence", 9)]  # a cycle and what hangs on it
    rows += [("odd", 5, 99, "evidence", 9), ("odd", 6, 5, "evidence", 9), ("odd", 7, None, "evidence", 9), ("odd", 8, None, None, 9)]  # dangling, evidence without a parent
    return [*rows, (None, 1, None, None, 9), (None, 2, 1, "evidence", 9)]


def test_places_depths_and_sizes(spark):
    rows = forest()
    got = {(x["history_name"], x["memory_id"]): (x["root_id"], x["depth"], x["size"], x["place"]) for x in trees.placed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == walked(rows)[0]


def test_packages_are_disjoint_and_in_order(spark):
    rows = forest()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = walked(rows)[1]
    assert sorted((tuple(x) for x in trees.packages(df).collect()), key=repr) == sorted(want, key=repr)
    waves = {}
    for h, _, i, d, members in sorted(want, key=lambda x: (x[3], x[2])):
        if len(members) > 1:
            waves.setdefault(h, []).append((h, len(waves.get(h, ())) + 1, i, d, members))
    assert sorted((tuple(x) for x in trees.wave(df).collect()), key=repr) == sorted((x for w in waves.values() for x in w), key=repr)


def test_an_empty_table(spark):
    assert trees.packages(spark.createDataFrame([], SCHEMA)).count() == 0
