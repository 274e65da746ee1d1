from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from assetgraph.llm import wordhash as wh
from hypothesis import given, settings
from hypothesis import strategies as st

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab Z\t\n\x0b.é漢0-", max_size=40)), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words_like_regex(texts):
    for table, pattern, fold in ((wh.space_table(), r"[^\x20\x09-\x0D]+", wh.KEEP), (wh.alnum_table(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", wh.LOWER)):
        w = wh.hash_words(pa.array(texts, pa.string()), table, fold)
        for i, t in enumerate(texts):
            t = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")) if fold is wh.LOWER else (t or "")
            got = [fold[w.raw[a:b]].tobytes().decode() for a, b in zip(w.starts[w.bounds[i] : w.bounds[i + 1]], w.ends[w.bounds[i] : w.bounds[i + 1]])]
            assert got == re.findall(pattern, t)


def test_hash_equality_and_chunks(monkeypatch):
    words = [f"w{i}" for i in range(5000)] + ["w1", "w1" * 200]
    monkeypatch.setattr(wh, "CHUNK", 64)
    h = wh.hash_words(pa.array([" ".join(words)]), wh.space_table()).hashes
    assert len(np.unique(h)) == 5001 and h[1] == h[5000]
    again = wh.hash_words(pa.array(["x", " ".join(words)]).slice(1), wh.space_table()).hashes
    assert (h == again).all()


def test_windows():
    w = wh.hash_words(pa.array(["a b a b a", "a b"]), wh.space_table())
    h, ok = wh.window_hashes(w.hashes, w.bounds, 2)
    assert ok.tolist() == [True, True, True, True, False, True, False]
    assert h[0] == h[2] == h[5] and h[1] == h[3] != h[0]


def test_no_algebraic_collisions():
    """Thue-Morse words and words that differ in a swap of blocks have different hashes in both lanes."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    words = ["".join("ab"[b] for b in bits[:n]) for n in (16, 32, 64, 1024, 2048)]
    words += ["".join("ba"[b] for b in bits[:n]) for n in (16, 32, 64, 1024, 2048)]
    words += ["abcdefgh12345678", "12345678abcdefgh", "a" * 64, "a" * 65, "a" * 66, "a", "ab", "a\0b"]
    w = wh.hash_words(pa.array([" ".join(words)]), wh.space_table(), lanes=2)
    assert len(np.unique(w.lanes[0])) == len(np.unique(w.lanes[1])) == len(words)
    assert not set(w.lanes[0].tolist()) & set(w.lanes[1].tolist())


def test_window_sizes():
    """Windows of any length: equal words give equal hashes, other words and lengths others."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 3, 60)]
    w = wh.hash_words(pa.array([" ".join(words)]), wh.space_table())
    seen: dict[int, tuple] = {}
    for k in range(1, 31):
        h, ok = wh.window_hashes(w.hashes, w.bounds, k)
        for p in np.flatnonzero(ok).tolist():
            assert seen.setdefault(int(h[p]), tuple(words[p : p + k])) == tuple(words[p : p + k])
        assert len({int(h[p]) for p in np.flatnonzero(ok)}) == len({tuple(words[p : p + k]) for p in np.flatnonzero(ok).tolist()})
