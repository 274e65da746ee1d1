"""Near duplicates, repeated passages, vectors, mixing and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from assetgraph.llm import ann_search, graph, jaccard_join, mixing, queries, substring_dedup
from pyspark.sql import functions as F

from tests.compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_texts(seed: int, n: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    boiler = [f"b{i}" for i in range(40)]
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " "), (3, "one two"), (4, "ONE two"), (None, "one two")]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([6, 20, 60, 150]))] for _ in range(n // 8)]
    for i in range(5, n):
        words = list(rng.choice(bases))
        if rng.random() < 0.3:
            words = words[: len(words) // 2] + boiler + words[len(words) // 2 :]
        for _ in range(rng.randrange(1 + len(words) // 25)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, (" " if rng.random() < 0.5 else "\n").join(words)))
    rows.append((7, "a row of the same id with quite different words in it"))
    return rows


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append((i, {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and sets[x][0] is not None and sets[y][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                up[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted(((i, len(s), None if i is None else least[root(x)]) for x, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("seed", "n", "group"), [(1, 200, 8), (2, 260, 2), (3, 120, 3)])
def test_jaccard(spark, monkeypatch, seed, n, group):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = near_texts(seed, n)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_signatures_share():
    """Linked sets share more signatures than the surplus; this is what makes the candidate filter exact."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 1 << 63, a).astype(np.uint64))
        other = base.copy()
        while True:
            change = rng.random()
            new = np.setdiff1d(other, rng.choice(other, 1)) if change < 0.5 and len(other) > 1 else np.union1d(other, rng.integers(0, 1 << 63, 1).astype(np.uint64))
            n = len(np.intersect1d(base, new))
            if 100 * n < 80 * (len(base) + len(new) - n):
                break
            other = new
        (x, none_x), (y, none_y) = jaccard_join.signatures(base), jaccard_join.signatures(other)
        j = jaccard_join.band_of(max(len(base), len(other)))
        low, t = np.uint64(63), jaccard_join.slack(j)
        assert all((h & low == j).any() for h in (x, y))
        parts = lambda h: {int(v) >> 6 & (jaccard_join._PARTS - 1) for v in h[h & low == j]}
        shared = parts(np.intersect1d(x, y)) - {jaccard_join._PREFIX}
        # parts with a shared subset, empty ones counted, are more than the slack; and with many empty ones a prefix feature is shared
        assert len(shared | parts(np.intersect1d(none_x, none_y))) > t
        assert shared or jaccard_join._PREFIX in parts(np.intersect1d(x, y))
        assert all(len(np.unique(h)) == len(h) for h in (x, y))


def test_popular_groups(spark, monkeypatch):
    """Large groups: near copies of one text, a chain that leaves the head's reach, unrelated texts with much in common."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(17)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(words)))
    words = list(base)
    for i in range(40):
        words[(i * 3) % 120] = f"c{i}"
        rows.append((len(rows), " ".join(words)))
    boiler = [f"b{i}" for i in range(90)]
    for i in range(60):
        rows.append((len(rows), " ".join([*boiler, *(f"u{rng.randrange(40)}" for _ in range(30))])))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(400, 460)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for s in sorted(near):
        todo = [] if s in want else [s]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = s
                todo += near[x]
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows, length):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - length + 1):
            if i is not None:
                k = tuple(w[p : p + length])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - length + 1):
            if i is not None and first[tuple(w[p : p + length])] < i:
                gone |= set(range(p, p + length))
        out.append((i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "batch"), [(13, 2000), (5, 700), (1, 4000), (30, 1 << 20)])
def test_substrings(spark, length, batch):
    rows = near_texts(5, 120)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int").repartition(3)
    got = substring_dedup.remove_repeats(docs, length=length, batch_bytes=batch).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_removed(rows, length)


def test_substrings_large_ids_and_like_words(spark):
    """Ids beyond 2**53 beside a null id, the ends of bigint, words of equal polynomial hashes, and repeated rows."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    twelve = " ".join(f"v{i}" for i in range(12))
    twenty = " ".join(f"u{i}" for i in range(20))
    rows = [(2**53, twenty), (2**53 + 1, twenty), (None, twenty), (1, f"{twelve} {one}"), (2, f"{twelve} {other}"), (3, f"x {twelve} {one}")]
    rows += [(-(2**63), twenty + " " + twelve), (2**63 - 1, twenty), (9, None), (10, ""), *[(77, "r s t " * 9)] * 40, (76, "r s t " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.remove_repeats(docs, batch_bytes=300).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == brute_removed(rows, 13)


def test_substrings_end_early_and_long_text(spark):
    """No level goes on without candidates; a text of some MB beside its passage."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(300_000))
    rows = [(1, long), (2, "a " * 3 + " ".join(long.split()[5000:5040])), (3, "b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == {1: (300_000, 0), 2: (43, 40), 3: (3, 0)}


def test_named_windows():
    """The window around the named one holds it and lies in its window."""
    for length in (5, 9, 13, 30):
        lengths = substring_dedup.level_lengths(length)
        place = np.arange(length - lengths[0] + 1)
        for m in lengths:
            start = substring_dedup.around(place, m, length, lengths[0])
            assert (start >= 0).all() and (start + m <= length).all() and (start <= place).all() and (start + m >= place + lengths[0]).all()


def test_levels():
    assert substring_dedup.level_lengths(13) == [4, 8, 13]
    assert substring_dedup.level_lengths(64) == [4, 8, 16, 32, 64]
    assert substring_dedup.level_lengths(3) == [3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert jaccard_join.jaccard_components(docs).count() == 0
    assert mixing.plan_mix(docs).count() == 0
    assert ann_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda v: v % 20 == 0).count() == 0


@pytest.mark.parametrize("name", ["op6_jaccard_join", "op7_substring_dedup", "op10_mix"])
def test_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(queries.ORACLE_SQL[name], SF)


def brute_neighbours(rows, k=20):
    """Of each repeated id the least vector; then all inner products among vectors of one length."""
    least: dict = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = tuple(float(np.float32(x)) for x in v)
            least[i] = min(least.get(i, v), v)
    out = {}
    for q in (i for i in least if i % 20 == 0):
        found = sorted((-sum(a * b for a, b in zip(least[q], v)), i) for i, v in least.items() if i != q and len(v) == len(least[q]))
        out[q] = [(round(-s, 6), i) for s, i in found]
    return out


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 24)).astype(np.float32)
    x[300:420] = x[7]
    short = rng.standard_normal((60, 5)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (620, [0.0] * 24), (640, [1.0] * 23 + [None]), (660, [1.0] * 23 + [float("nan")]), (680, [1.0] * 23 + [float("inf")]), (None, x[0].tolist()), (5, x[5].tolist())]
    rows += [(1000 + i, v.tolist()) for i, v in enumerate(short)] + [(2000, [3.0]), (40, (x[40] + 1).tolist()), (41, (x[41] - 1).tolist()), (20, x[400].tolist())]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    want = brute_neighbours(rows)
    got: dict[int, list] = {}
    for r in ann_search.search(df, lambda v: F.pmod(v, F.lit(20)) == 0, cell_rows=90).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {q for q in want if want[q]}
    hit = total = 0
    for q, found in got.items():
        score = {i: s for s, i in want[q]}
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and len({f[1] for f in found}) == len(found)
        assert [f[1] for f in found] == [i for _, i in sorted((-s, i) for _, i, s in found)]
        assert all(abs(s - score[i]) < 1e-5 for _, i, s in found)
        hit, total = hit + len({i for _, i in want[q][:20]} & {f[1] for f in found}), total + min(20, len(want[q]))
    assert hit >= 0.9 * total
    # all lists, no test that can err: exact
    exact: dict[int, list] = {}
    for r in ann_search.search(df, lambda v: F.pmod(v, F.lit(20)) == 0, cell_rows=90, query_rows=7, lists=20, probes=20, z=1e9).orderBy("query_id", "rank").collect():
        exact.setdefault(r.query_id, []).append(r.vec_id)
    assert exact == {q: [i for _, i in w[:20]] for q, w in want.items() if w}
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann_search.search(few, lambda v: v % 20 == 0).collect()] == [(0, 1, 1, 5.0)]
    assert ann_search.search(few.where("vec_id = 0"), lambda v: v % 20 == 0).count() == 0


def test_adaptive_scan():
    """The tests give up most far candidates and hardly any near one; with limits of infinity all stay."""
    rng = np.random.default_rng(3)
    turn = ann_search.rotation(64)
    q, r = (v / np.linalg.norm(v, axis=1)[:, None] @ turn for v in (rng.standard_normal((50, 64)), rng.standard_normal((3000, 64))))
    far = ann_search.distances(q, r)
    limit = np.sort(far, axis=1)[:, 20]
    i, j, d = ann_search.adaptive_scan(q, r, limit, 16, 2.0)
    assert np.allclose(d, far[i, j]) and (d <= limit[i] + 1e-6).all() and len(i) >= 0.97 * 50 * 20
    assert len(ann_search.adaptive_scan(q, r, np.full(50, np.inf), 16, 2.0)[0]) == 150_000


def brute_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), rng.choice(["a"] * 6 + ["b", "c", "d", "é", "", None]), 1) for i in range(500)] + [(500, None, "a", 1), (3, "x y", "a", 1), (3, "x y", "a", 1), (None, "x", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(4)
    mix = mixing.plan_mix(df)
    got = [{**r.asDict(), "taken": sum(c.words for c in r.copies)} for r in mix.collect()]
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken: dict = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken, r.position or -1)
    assert sorted(map(key, mixing.scheduled_mix(df).collect())) == sorted(map(key, mixing.scheduled_mix(df.repartition(7)).collect()))
    # the copies lie end to end in each source, and their positions are those of the numeric inversion
    rings: dict = {}
    for r in got:
        rings.setdefault(r["source"], []).append(r)
        m = 0.5 * (r["rank"] % 3 - 1)
        for lap, c in enumerate(r["copies"]):
            assert abs(c.position - brute_position((lap * r["source_size"] + r["offset"]) / round(r["target"]), m)) < 1e-9
    for ring in rings.values():
        at = 0
        for r in sorted(ring, key=lambda r: (r["offset"], r["size"])):
            assert r["offset"] == at
            at += r["size"]
    plan = mixing.schedule(mix).collect()
    assert sum(r.words for r in plan) == sum(r["taken"] for r in got) and all(0 <= r.position < 1 for r in plan)


def brute_position(share, m):
    """The time at which the integral of 1 + m * (2t - 1) reaches share, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if (1 - m) * t + m * t * t < share else (lo, t)
    return lo


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randrange(10), i) for i in range(500)] + [("a", 1, 1000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long, row long").repartition(5)
    at = 0
    got = {r.row: r.s for r in mixing.running_sums(df, ["k", "v", "row"], {"s": "v"}).collect()}
    for _, v, i in sorted(rows):
        assert got[i] == at
        at += v


def test_mix_keeps_columns_and_order(spark):
    rows = [(i, "w " * (i % 30), f"s{i % 4}", i) for i in range(200)] + [(None, "a b", None, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    with pytest.raises(ValueError):
        mixing.scheduled_mix(df.withColumnRenamed("extra", "Position"), keep=["doc_id", "Position"])
    out = mixing.scheduled_mix(df, keep=df.columns)
    assert out.columns == ["doc_id", "text", "source", "extra", "size", "source_size", "target", "taken", "position"]
    got = out.collect()
    assert sorted((r[:4] for r in got), key=repr) == sorted(rows, key=repr)
    position = [r.position or -1 for r in got]
    assert position == sorted(position)


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dups", "decontaminate", "secret_scan", "mix"]
    base = "zorb flin tark mool grint wask pelt nurb voss kine dral sump hoke bint"
    bench = spark.createDataFrame([(1, base)], "item_id long, text string")
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    clean = [" ".join(word() for _ in range(40)) for _ in range(6)]
    texts = [*clean, clean[0], base + " tail", "1234 !!", None, clean[1] + " password=abcdefgh12"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-test-")
    docs.write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, folder)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(range(11)) - {8, 9}
    two = stages["near_dups"](spark, docs, folder)
    assert {r.doc_id for r in two.collect()} == set(range(11)) - {6, 10}
    three = stages["decontaminate"](spark, docs, folder)
    assert {r.doc_id for r in three.collect()} == set(range(11)) - {7}
    four = {r.doc_id: r.text for r in stages["secret_scan"](spark, docs, folder).collect()}
    assert four[10] == clean[1] + " [ASSIGN]" and four[0] == clean[0] and four[9] is None
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == set(range(6)) and all(r.text == clean[r.doc_id] for r in out)
    assert [r.position for r in out] == sorted(r.position for r in out)
    assert sum(r.taken for r in out) == 360


CLASHES = "lang_pred score contaminated n_words items spans redacted n_hit component_id row kept position taken size source_size target n_assign doc_id_2".split()


def test_pipeline_keeps_any_column(spark, tmp_path):
    """Columns with the names of results go through every stage, chained without writing; two chains do not disturb each other; nothing stays behind."""
    from assetgraph.llm import common

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(20))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [" ".join(word() for _ in range(40)) for _ in range(6)]
    texts = [*clean, clean[0], passage, "1234", clean[1] + " token=abcdefgh12"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in CLASHES})
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    def chain():
        out = docs
        for _, make in corpus_pipeline.STAGES:
            out = make(spark, out, str(tmp_path))
        return out

    before = set(common.scratch_paths())
    with common.scratch_scope() as made:
        one, two = chain(), chain()
        for out in (one, two, corpus_pipeline.run(spark, str(tmp_path))):
            assert out.columns == [f"document_{c}" if c in ("position", "taken", "size", "source_size", "target") else c for c in docs.columns] + ["size", "source_size", "target", "taken", "position"]
            rows = out.collect()
            assert {r.doc_id for r in rows} == set(range(6))
            for r in rows:
                assert all(r[f"document_{c}" if c in ("position", "taken", "size", "source_size", "target") else c] == f"{c} of {r.doc_id}" for c in CLASHES)
                assert r.size == 40 and r.source_size == 240 and r.text == clean[r.doc_id]
    assert len(made) == len(set(made)) and set(common.scratch_paths()) - before <= set(made)
    substring_dedup.remove_repeats(docs.select("doc_id", "text")).count()
    common.clear_scratch(spark, common.scratch_paths())
    assert not [t for t in spark.catalog.listTables() if "repeats" in t.name] and not common.scratch_paths()


def test_pipeline_empty_and_long(spark, tmp_path):
    """Empty tables give empty tables of the same columns; a text of 200,000 words goes through."""
    spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    for name, make in corpus_pipeline.STAGES:
        out = make(spark, empty, str(tmp_path))
        assert out.count() == 0 and out.columns[:5] == empty.columns and (name == "mix") == (len(out.columns) > 5)
    rng = random.Random(6)
    long = " ".join(f"{rng.randrange(10**6):x}q" for _ in range(200_000))
    out = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long + " more", "en", "s", 3), (3, "short text here", "en", "t", 4)], schema)
    for _, make in corpus_pipeline.STAGES:
        out = make(spark, out, str(tmp_path))
    assert {(r.doc_id, r.size) for r in out.collect()} == {(1, 200_000), (3, 3)}


def test_hot_nodes_and_cells(spark, monkeypatch):
    """Nodes of high degree are joined apart; cells are bounded by bytes; the results stay the same."""
    monkeypatch.setattr(graph, "HOT_NODES", 3)
    monkeypatch.setattr(graph, "LEAST_HOT", 1024)
    rng = random.Random(4)
    edges = [(10_000, i) for i in range(2000)] + [(0, 5000 + i) for i in range(1500)] + [(rng.randrange(6000, 6400), rng.randrange(6000, 6400)) for _ in range(300)] + [(7000 + i, 7001 + i) for i in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", 600)
    rows = near_texts(7, 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_compare_does_not_copy():
    """A cell of sets of 20,000 features holds little more than its bytes."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 20_000).astype(np.uint64))
    sets = [base.copy() for _ in range(17)]
    table = pa.table({"kind": pa.array([0] * 17, pa.int32()), "side": pa.array([0] + [1] * 16, pa.int32()), "row": pa.array(range(17)), "features": pa.array([s.tobytes() for s in sets], pa.binary())})
    tracemalloc.start()
    out = jaccard_join._compare(table)
    assert out.num_rows == 16 and tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_rows_decide_for_themselves(spark, tmp_path):
    """Ids that repeat or are null: the stages drop rows by their own text."""
    stages = dict(corpus_pipeline.STAGES)
    passage = "zorb flin tark mool grint wask pelt nurb voss kine dral sump hoke bint"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(3)
    one, two, three = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(3))
    frame = lambda rows: spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string").repartition(3)
    rows = [(None, passage, "a"), (None, one, "a"), (7, passage, "a"), (7, two, "b"), (7, three, None), (8, passage + " x", "a"), (8, passage + " x", "a"), (8, None, "c")]
    left = stages["decontaminate"](spark, frame(rows), str(tmp_path))
    assert left.columns == ["doc_id", "text", "lang", "source"]
    want = sorted(((i, t, s) for i, t, s in rows if passage not in (t or "")), key=repr)
    assert sorted(((r.doc_id, r.text, r.source) for r in left.collect()), key=repr) == want
    rows = [(4, one, "a"), (4, one, "a"), (4, two, "a"), (5, one + " x", "b"), (None, one, "c"), (None, three, "a"), (None, three, "a"), (3, two, "b")]
    left = stages["near_dups"](spark, frame(rows), str(tmp_path))
    assert left.columns == ["doc_id", "text", "lang", "source"]
    assert sorted(((r.doc_id, r.text, r.source) for r in left.collect()), key=repr) == sorted([(4, one, "a"), (3, two, "b"), (None, three, "a")], key=repr)


def test_written_frees_shuffles(spark):
    """What a written table's plan shuffled is gone when it is written, and the session's settings are as before."""
    from assetgraph.llm import common

    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files() -> set[str]:
        found = manager.getAllFiles()
        return {f for i in range(found.size()) if (f := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    df = spark.range(5000).selectExpr("id % 100 as k", "id").groupBy("k").count()
    one, two = common.written(df, "shuffled"), common.written_by(df, "shuffled", "k", 3)
    assert files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert one.count() == two.count() == 100
    with common.settings(spark, {"spark.sql.test.a": "1"}):
        with common.settings(spark, {"spark.sql.test.a": "1"}):
            pass
        assert spark.conf.get("spark.sql.test.a") == "1"
    assert spark.conf.get("spark.sql.test.a", None) is None


def test_batches_bounded_by_bytes(spark):
    """Python workers of the similarity join are given batches of bounded bytes, not of 10,000 rows."""
    import pyarrow as pa

    from assetgraph.llm import common

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("repeat('some words ', 100) as text")
    n = [r.n for r in common.written(docs.mapInArrow(run, "n long"), "batches", batch_bytes=1 << 17).collect()]
    assert sum(n) == 3000 and max(n) <= 150
    asked = []
    real = jaccard_join.written
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard_join, "written", lambda df, name, **kw: asked.append((name, kw.get("batch_bytes"))) or real(df, name, **kw))
        jaccard_join.jaccard_components(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string")).collect()
    assert {n for n, size in asked if size and size <= 4 << 20} == {"shingle-sets", "candidates", "compared", "block-links"}


def test_near_dups_shuffles_texts_once(spark, tmp_path):
    """The rows that near_dups keeps are found without a shuffle of their texts."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"{rng.randrange(10**5):x}q" for _ in range(30)), "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dict(corpus_pipeline.STAGES)["near_dups"](spark, docs, str(tmp_path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and out.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blocks_by_band(spark):
    """Open sets that share a signature meet in a cell; those that only a set of two bands ties together do not."""
    a, b = -(1 << 40) | 5, -(1 << 40) | 6
    held = spark.createDataFrame([(1, a, 1), (5, a, 1), (6, a, 1), (2, b, 2), (6, b, 2), (7, b, 2)], "key long, sig long, head long")
    stars = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.5), (2, 6, 0.5), (2, 7, 0.5)], "a long, b long, far double")
    parts = spark.createDataFrame([], "node long, component long")
    shown = spark.createDataFrame([(k, 20) for k in (1, 2, 5, 6, 7)], "key long, n_shingles long")
    cells: dict = {}
    for r in jaccard_join._blocks(held, stars, parts, shown).collect():
        cells.setdefault((r.c1, r.c2), set()).add(r.key)
    assert sorted(map(sorted, cells.values())) == [[5, 6], [6, 7]]
