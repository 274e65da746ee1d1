"""Least evidence, source sets, the executable graph's edges and merged boundaries, on cyclic graphs against plain Python."""

from __future__ import annotations

import random

import pytest
from assetgraph.operators import boundaries, reach

SEEDS = (1, 2)


def random_graph(seed, n=25, m=45):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.randrange(4), rng.choice(["a", "b", "é", "\U0001f600", "～"])) for _ in range(m)]


@pytest.mark.parametrize("seed", SEEDS)
def test_least_evidence(spark, seed):
    """Relaxed until nothing changes, as a fixpoint over tuples; loops, cycles back to the owner and repeated references."""
    refs, owners = random_graph(seed), ["n0", "n1", "n7", "absent"]
    key = lambda e: (e[0], e[1].encode("utf-16-be"), e[2], e[3].encode("utf-16-be"))
    want = {}
    for owner in owners:
        best, changed = {}, True
        while changed:
            changed = False
            for src, dst, line, raw in refs:
                depth = 0 if src == owner else best[src][0] if src in best else None
                if depth is not None:
                    e = (depth + 1, src, line, raw)
                    if dst not in best or key(e) < key(best[dst]):
                        best[dst], changed = e, True
        want |= {(owner, node): e for node, e in best.items()}
    got = reach.least_evidence(spark.createDataFrame(refs, "src string, dst string, line int, raw string"), spark.createDataFrame([(o,) for o in owners], "owner string")).collect()
    assert {(r.owner, r.node): (r.depth, r.source, r.line, r.raw) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("seed", SEEDS)
def test_reach_sets(spark, seed):
    """More sources than a word has bits."""
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(300)]
    sources = sorted(rng.sample(range(200), 150)) + [999]
    want = {}
    for s in sources:
        depth, front = {s: 0}, [s]
        while front:
            front = [b for a in front for x, b in edges if x == a and b not in depth and not depth.update({b: depth[a] + 1})]
        for node, d in depth.items():
            least, found = want.get(node, (d, []))
            want[node] = (min(least, d), [*found, s])
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: (r.depth, r.sources) for r in reach.reach_sets(df, spark.createDataFrame([(s,) for s in sources], "source long")).collect()}
    assert got == want


def test_modes(spark):
    nodes = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "node long, eligible boolean")
    routes, one = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), spark.createDataFrame([(1,)], "source long")
    rows = lambda entry, adoption: {r.node: (r.mode, r.state, r.depth, r.sources) for r in reach.route_reachability(nodes, routes, entry, adoption).collect()}
    assert rows(one, "adopted") == {1: ("authoritative", "reachable", 0, [1]), 2: ("authoritative", "reachable", 1, [1]), 3: ("authoritative", "not-evaluated", None, []), 4: ("authoritative", "not-reached", None, [])}
    assert rows(one, "partial")[2] == ("descriptive", "reachable", 1, [1])
    for entry, adoption in ((one.where("false"), "partial"), (one, "not-adopted")):
        assert all(v == ("not-evaluated", "not-evaluated", None, []) for v in rows(entry, adoption).values())


def test_boundaries(spark):
    a = boundaries.Boundary("a", ("x/*", "z"), ("b", "é"), 10, 2)
    b = boundaries.Boundary("b", ("**",), ("é", "q"), 20, 1)
    assert boundaries.merged([a, b]) == boundaries.Boundary("a+b", ("**", "x/*", "z"), ("é",), 20, 2)
    paths = [("x/1", 5), ("x/1/2", 5), ("b/x", 1), ("q", 1), ("z", 15), ("é/z", 1), ("a/b/c/d", 1)]
    got = {r.path: (r.inspected, r.boundaries) for r in boundaries.union_scan(spark.createDataFrame(paths, "path string, size long"), (a, b)).collect()}
    assert got == {"x/1": (True, ["a", "b"]), "x/1/2": (False, []), "b/x": (True, ["b"]), "q": (False, []), "z": (True, ["b"]), "é/z": (False, []), "a/b/c/d": (False, [])}
