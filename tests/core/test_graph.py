from __future__ import annotations

import random

from assetgraph.operators import graph, policy


def edges(spark, rows):
    return spark.createDataFrame([(a, b, r) for a, b, r in rows], "src long, dst long, required boolean")


def brute_closure(rows, root):
    best = {}
    todo = [(root, True)]
    while todo:
        n, req = todo.pop()
        if n in best and (best[n] or not req):
            continue
        best[n] = req
        todo += [(b, req and r) for a, b, r in rows if a == n]
    return {n: ("required" if r else "optional") for n, r in best.items() if n != root}


def test_closures_and_reachability(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(14), rng.randrange(14), rng.random() < 0.5) for _ in range(22)] + [(1, 1, True)]
    e = edges(spark, rows)
    roots = spark.createDataFrame([(0,), (1,), (99,)], "root long")
    got = {}
    for r in graph.composition_closure(e, roots).collect():
        got.setdefault(r.root, {})[r.node] = r.membership
    for root in (0, 1, 99):
        assert got.get(root, {}) == brute_closure(rows, root)
    back = {}
    for r in graph.impact_closure(e, roots).collect():
        back.setdefault(r.root, {})[r.node] = r.membership
    assert back.get(0, {}) == brute_closure([(b, a, r) for a, b, r in rows], 0)
    depth = {r.node: r.depth for r in graph.reachability(e, spark.createDataFrame([(0,)], "source long")).collect()}
    want, front, d = {0: 0}, {0}, 0
    while front:
        d += 1
        front = {b for a, b, _ in rows if a in front} - set(want)
        want |= {n: d for n in front}
    assert depth == want


def test_cycles(spark):
    rows = [(1, 2, True), (2, 3, True), (3, 1, False), (3, 4, True), (4, 5, True), (6, 6, True), (7, 8, True), (8, 7, True)]
    got = {r.node: r.component for r in graph.cycle_members(edges(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 7, 8: 7}
    assert graph.cycle_members(edges(spark, [])).count() == 0


def test_shapes_and_focus(spark):
    e = edges(spark, [(1, 2, True), (2, 3, True)])
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "node long")
    assert {r.node: r["shape"] for r in graph.structural_roots(nodes, e).collect()} == {1: "root", 2: "inner", 3: "inner", 4: "standalone"}
    assert graph.focus_edges(e, 1).count() == 1


def test_cycles_of_random_graphs(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = [(rng.randrange(25), rng.randrange(25), True) for _ in range(32)]
        reach = {n: set() for n in range(25)}
        for n in reach:
            todo = [b for a, b, _ in rows if a == n]
            while todo:
                x = todo.pop()
                if x not in reach[n]:
                    reach[n].add(x)
                    todo += [b for a, b, _ in rows if a == x]
        want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}
        assert {r.node: r.component for r in graph.cycle_members(edges(spark, rows)).collect()} == want


def test_deep_profile_chain(spark):
    rows = [(f"p{i}", f"p{i - 1}" if i else None) for i in range(24)] + [("x", "y"), ("y", "x"), ("z", "gone")]
    got = {r.name: (len(r.chain), r.state) for r in policy.profile_chain(spark.createDataFrame(rows, "name string, parent string")).collect()}
    assert got == {f"p{i}": (i + 1, "complete") for i in range(24)} | {"x": (0, "cycle"), "y": (0, "cycle"), "z": (0, "missing")}
