"""BPE, whitening and lexical search against the library, numpy and brute force."""

from __future__ import annotations

import math
import random
import re
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from assetgraph.llm import bpe, lexical_search, queries, whitening
from tokenizers import Tokenizer

from tests.compare import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


# ---- op11


def odd_texts(n: int) -> list[str]:
    rng = random.Random(3)
    some = ["  ", "\n\n", "\t", "'re", "'S", "aaa", "1a2", "<|endoftext|>", "<|endoftext|", "é", "漢字", "՘", "\U00010940", "\U00011de0", "　", "\x1c", "\x85", "\xa0", "​", "﻿", "!?", "word", "Ġ"]
    any_char = lambda: chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))
    return ["", " ", "aaaaaaaaaaaaaaaaa", "<|endoftext|><|endoftext|>"] + ["".join(rng.choice(some) if rng.random() < 0.8 else any_char() for _ in range(rng.randrange(25))) for _ in range(n)]


def test_bpe_like_library(library):
    v = bpe.read_vocabulary(PATH)
    encoder, texts = bpe.Encoder(v), odd_texts(2000)
    for text, ids in zip(texts, encoder.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert bpe.decode_ids(ids.astype(np.int64), v).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_every_letter(library):
    """Each code point of one in nine, beside a letter, a digit and a blank."""
    texts = [f"a{chr(c)}1 {chr(c)}" for c in range(0, 0x110000, 9) if not 0xD800 <= c < 0xE000]
    got = bpe.Encoder(bpe.read_vocabulary(PATH)).encode(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_pieces_and_memory(library, monkeypatch):
    """Small pieces, portions and memory change nothing; a word of a megabyte and random ids work."""
    v = bpe.read_vocabulary(PATH)
    texts = odd_texts(300) + ["the quick  brown fox " * 400, "ab" * 20_000]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "PIECE", 7)
    monkeypatch.setattr(bpe, "PORTION", 50)
    monkeypatch.setattr(bpe, "KEPT", 20)
    encoder = bpe.Encoder(v)
    assert [g.tolist() for g in encoder.encode(texts)] == want
    assert [encoder.encode([t])[0].tolist() for t in texts] == want
    assert len(bpe.Encoder(v).encode(["xy" * 500_000])[0]) > 0
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(9))]
        assert bpe.decode_ids(np.array(ids, np.int64), v).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_refuses(tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('{"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2, "aba": 3}, "merges": ["ab a", "a b"]}, "pre_tokenizer": {"type": "ByteLevel"}}')
    with pytest.raises(ValueError):
        bpe.read_vocabulary(str(bad))
    with pytest.raises(ValueError):
        bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_query(spark, library):
    rows = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    out = queries.QUERIES["op11_bpe"](spark, SF).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edges(spark):
    docs = spark.createDataFrame([(1, None, 5, "x"), (1, "", 6, "y"), (None, "the the", 7, "z"), (2, "the the", 8, "z")], "doc_id long, text string, ids int, decoded string")
    coded = bpe.encode_bpe(docs, PATH)
    got = sorted(((r.doc_id, tuple(r.ids)) for r in coded.collect()), key=repr)
    assert got == sorted([(1, ()), (1, ()), (None, (1169, 262)), (2, (1169, 262))], key=repr)
    assert sorted(r.decoded for r in bpe.decode_bpe(coded, PATH).collect()) == ["", "", "the the", "the the"]
    odd = spark.createDataFrame([(1, [1169, None, -4, 60000, 262]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode_bpe(odd, PATH).collect()} == {1: "the the", 2: ""}
    assert bpe.decode_bpe(bpe.encode_bpe(docs.limit(0), PATH), PATH).count() == 0


# ---- op12


def brute_whiten(rows, most=16):
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for dims in sorted({len(v) for _, v in kept}):
        own = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in kept if len(v) == dims]
        fit = sorted({tuple(x) for _, x in own})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        y = np.array([[float(n * c - t) / n for c, t in zip(x, s)] for x in fit])
        cov = y.T @ y / n
        e, w = np.linalg.eigh(cov)
        order = [k for k in np.argsort(-e)[:most] if e[k] > 1e-11 * e.max() and e[k] > 0]
        for i, x in own:
            c = np.array([float(n * a - t) / n for a, t in zip(x, s)])
            dev = sum((n * a - t) ** 2 for a, t in zip(x, s))
            for at, k in enumerate(order, 1):
                out.append((i, at, n, dev if dev < 2**63 else None, float(c @ w[:, k] / math.sqrt(e[k])), float(e[k] / np.trace(cov))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], repr(r[3])))


def same_whitening(got, want):
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1], repr(r[3])))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for k in {w[1] for w in want}:
        a, b = np.array([g[4] for g in got if g[1] == k]), np.array([w[4] for w in want if w[1] == k])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-6)


@pytest.mark.parametrize(("tile", "rows"), [(128, 4096), (16, 50), (5, 7)])
def test_whiten_like_numpy(spark, monkeypatch, tile, rows):
    monkeypatch.setattr(whitening, "TILE", tile)
    monkeypatch.setattr(whitening, "ROWS", rows)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 24)) @ rng.standard_normal((24, 24)) * 3
    data = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(i, [float(c) for c in base[0]]) for i in range(400, 600)]
    data += [(900, None), (901, []), (902, [None] * 24), (903, [float("nan")] * 24), (904, [float("inf")] * 24), (None, data[1][1]), (5, data[2][1])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in data], "vec_id long, embedding array<double>, whitened double, n int").repartition(3)
    got = whitening.whiten(df).collect()
    same_whitening(got, brute_whiten(data))
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) <= 1e-4 and len({r.identity_error for r in got}) == 1


def test_whiten_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(df([])).collect() == [] == whitening.whiten(df([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    rng = np.random.default_rng(1)
    flat = [(i, [float(a), 2 * float(a), 3.0]) for i, a in enumerate(rng.integers(0, 50, 40))]  # one direction only
    assert {r.component for r in whitening.whiten(df(flat)).collect()} == {1}
    mixed = flat + [(100 + i, [float(c) for c in v]) for i, v in enumerate(rng.integers(-9, 9, (30, 2)))] + [(7, [1e30, 5.0, 4.0])]
    got = whitening.whiten(df(mixed))
    assert {(r.n, r.component) for r in got.where("vec_id between 100 and 129").select("n", "component").collect()} == {(len({tuple(v) for i, v in mixed if 100 <= i < 130}), k) for k in (1, 2)}
    assert got.where("vec_id = 7 and deviation is null").count()  # of the far entry, beyond a long


def test_whiten_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    got = queries.QUERIES["op12_whiten"](spark, SF).collect()
    same_whitening(got, brute_whiten(rows))
    assert max(r.identity_error for r in got) <= 1e-4


# ---- op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    words = [(i, terms(t)) for i, t in docs if terms(t)]
    n, total = len(words), sum(len(w) for _, w in words)
    df: dict[str, int] = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        found = []
        for d, w in words:
            m = 100 - 90 + 90 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in own & set(w))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "longest", "most_terms"), [(16 << 20, 64, 1_000_000), (3000, 8, 1_000_000), (300, 3, 40)])
def test_search_like_brute_force(spark, monkeypatch, shard, longest, most_terms):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search.block_ends, "__defaults__", (longest, lexical_search.COST))
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(120)] + ["É", "ÉÈ", "Straße", "the"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join("the" if rng.random() < 0.2 else vocabulary[min(int(rng.expovariate(0.05)), 123)].upper() for _ in range(n))
    docs = [(i, text(rng.randrange(1, 90))) for i in range(400)] + [(None, "w1 w2 w3"), (None, None), (500, None), (501, ""), (502, "?!"), (3, "w1 w1 w1"), (600, "w3 " * 3000)] + [(700 + i, "w5 w6 the") for i in range(30)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(40)] + [(None, "w5 the"), (90, None), (91, ""), (92, "nowhere"), (5, "w7"), (93, "w5 w6 w5")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, item int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = lexical_search.lexical_search(d, q, most_terms=most_terms)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == brute_search(docs, items)


def test_search_empty(spark):
    d, q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.lexical_search(d.limit(0), q).count() == lexical_search.lexical_search(d, q.limit(0)).count() == 0


def test_block_ends_are_best():
    """No other division into blocks costs less."""
    rng = np.random.default_rng(3)
    lists = [rng.integers(1, 50, n) for n in (1, 7, 3, 9, 1, 8)]
    bounds = np.cumsum([0, *map(len, lists)])
    scores = np.concatenate(lists)

    def cost(s, ends):
        parts = np.split(s, [e + 1 for e in ends[:-1]])
        return sum(len(p) * p.max() - p.sum() for p in parts) + len(parts) * max(0.5 * s.max(), 1)

    for longest in (3, 64):
        ends = lexical_search.block_ends(scores, bounds, longest)
        for i, s in enumerate(lists):
            own = [int(e) - bounds[i] for e in ends if bounds[i] <= e < bounds[i + 1]]
            all_ways = ([j for j in range(len(s)) if j == len(s) - 1 or way >> j & 1] for way in range(1 << (len(s) - 1)))
            fit = [w for w in all_ways if max(np.diff([-1, *w])) <= longest]
            assert own in fit and cost(s, own) == min(cost(s, w) for w in fit)


def test_search_sql(spark):
    assert spark_rows(queries.QUERIES["op13_search"](spark, SF)) == duck_rows(queries.ORACLE_SQL["op13_search"], SF)


def test_search_skips():
    """A frequent word's postings are mostly skipped once better documents are known."""
    n = 5000
    term = np.r_[np.zeros(n, np.int64), np.ones(20, np.int64)]
    doc = np.r_[np.arange(n), np.arange(20) * 37]
    score = np.r_[np.full(n, 10), np.full(20, 1000)]
    shard = lexical_search.Shard(term, doc, score, 2, n)
    opened = []
    whole, shard.scores_of = shard.scores_of, lambda docs, blocks: (opened.append(len(docs)), whole(docs, blocks))[1]
    at, scores = shard.search(np.array([0, 1]), 1, 10, [])
    assert sorted(scores)[-20:] == [1010] * 20 and len(set(at)) == len(at) and sum(opened) < 1500
    assert not len(shard.search(np.array([0]), 11, 10, [11] * 10)[0])
