"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import random

import pytest
from assetgraph import queries as core
from assetgraph.operators import duplicates
from pyspark.sql import functions as F

from tests.compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(core.ORACLE_SQL))
def test_against_sql(spark, name):
    assert spark_rows(core.QUERIES[name](spark, SF)) == duck_rows(core.ORACLE_SQL[name], SF)


@pytest.mark.parametrize(("seed", "paths", "others"), [(4, 4, 40), (5, 30, 12), (6, 3, 200), (7, 60, 25)])
def test_collapse(spark, seed, paths, others):
    """Greedy collapse against plain Python on groups with near starts and with equal other places in different first documents."""
    rng = random.Random(seed)
    rows = [(f"k{i:03d}é😀"[: rng.choice([4, 5, 6])] + str(i), rng.randrange(3, 6), rng.randrange(3, 9), rng.randrange(paths), rng.randrange(1, 120), rng.randrange(120, 130), f"o{rng.randrange(others)}") for i in range(300)]
    groups = spark.createDataFrame(rows, "key string, n_docs long, n long, path long, start_line int, end_line int, others string")
    units = lambda s: s.encode("utf-16-be")
    kept: list = []
    for r in sorted(rows, key=lambda r: (units(str(r[3])), r[4], r[5], units(r[0]))):
        if not any((x[3] == r[3] and abs(x[4] - r[4]) <= 8) or x[6] == r[6] for x in kept):
            kept.append(r)
    out = duplicates.collapse_shingles(groups)
    assert {r.key for r in out.collect()} == {r[0] for r in kept}
    best = sorted(kept, key=lambda r: (-r[1], -r[2], units(r[0])))[:10]
    assert [r.key for r in duplicates.ranked_groups(out).collect()] == [r[0] for r in best]
    assert duplicates.collapse_shingles(groups.limit(0)).count() == 0


def test_fences(spark):
    lines = ["a", "```py", "b", "~~~", "```", "c", "~~~~", "d"]
    got = spark.createDataFrame([(lines,), (["x", "y"],)], "l array<string>").select(duplicates.outside_fences(F.col("l")).alias("k")).collect()
    assert [[(r.line, r.content) for r in row.k] for row in got] == [[(1, "a"), (6, "c")], [(1, "x"), (2, "y")]]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_window_hashes(spark):
    rng = random.Random(1)
    words = [rng.choice("abc") for _ in range(60)]
    for length in (1, 3, 8, 40):
        got = duplicates.window_hashes(spark.createDataFrame([(words,), (["a"],)], "w array<string>"), "w", length).collect()
        windows = [tuple(words[i : i + length]) for i in range(61 - length)]
        assert len(got[0].h) == len(windows) and len(set(zip(windows, got[0].h))) == len(set(windows)) == len(set(got[0].h)) and len(got[1].h) == (length == 1)


def test_anchors_bound_the_windows(spark, monkeypatch):
    """Windows that come back are found by anchors, against plain Python; of texts that share none, no window is shuffled or written."""
    rng = random.Random(3)
    some = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 90))) for _ in range(30)]
    texts += [" ".join([*(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(30))), *rng.choice(some)[rng.randrange(8) :], "end", *rng.choice(some)[:45]]) for _ in range(14)] + ["", None, "short"]
    tables = {}
    real = duplicates.written
    monkeypatch.setattr(duplicates, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    got = duplicates.shingle_groups(duplicates.token_windows(spark.createDataFrame(list(enumerate(texts)), "d int, t string"), "d", "t"), "d").collect()
    where: dict = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        for p in range(len(w) - 39):
            where.setdefault(" ".join(w[p : p + 40]), set()).add(i)
    assert {r.key: (r.n_docs, r.path) for r in got} == {k: (len(v), min(v)) for k, v in where.items() if len(v) >= 3} and got
    assert {r.d for r in tables["tokens"].select("d").collect()} <= set(range(30, 44))
    windows = sum(max(0, len((t or "").split()) - 39) for t in texts)
    assert tables["anchors"].count() < windows / 4
    values = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 4, 5, 6, 40)]
    for width in (1, 2, 5, 33):
        rows = spark.createDataFrame([(v,) for v in values], "v array<int>").select(duplicates.sliding_least(F.col("v"), width).alias("m")).collect()
        assert [r.m for r in rows] == [[min(v[i : i + width]) for i in range(len(v) - width + 1)] for v in values]
