"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1, drawn
from its code point alone, so tasks agree on it without sharing state.  An n-gram
vector binds its letters' vectors by multiplication after rotating each by its
place; a text's vector bundles (sums) its n-gram vectors; a language's prototype
bundles the vectors of its training texts, each scaled to unit length.  Texts go
to the language of largest cosine.

Prototypes are fitted on training rows with text and language.  Each language
contributes a sample of about `sample_per_lang` rows, chosen by a hash of the id
(a documented bound for a classifier), and the `max_langs` languages of most rows are learned, so dirty labels fill
neither the driver nor the tasks; all texts are predicted, each as a whole.

Text is lower-cased; runs of non-letters count as one gap.  A text without any
letter, or null, gives `und` with score 0.  Ties go to the language first in
code-point order.  With nothing to learn from, every text is `und`.  Equal rows
get equal results.  Columns other than id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import refuse_clash, written
from .wordhash import chunks, mix

DIMENSIONS = 512
N = 3
MOST_LANGS = 4096
_BLOCK = 1 << 18  # letters handled at once


def letter_vectors(points: np.ndarray, dims: int) -> np.ndarray:
    """One row of +1/-1 for each code point, drawn by hashing (point, place)."""
    with np.errstate(over="ignore"):
        seed = mix(points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        words = mix(seed[:, None] + np.arange(dims // 64, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1)
    return bits[:, :dims].astype(np.int8) * 2 - 1


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, each run of others as one 32; empty if there is no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    keep = _is_letter(points)
    if not keep.any():
        return np.zeros(0, np.uint32)
    points = np.where(keep, points, np.uint32(32))
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    gap = points == 32
    return points[~(gap & np.concatenate([[False], gap[:-1]]))]


_LETTER = np.zeros(0, bool)


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000)
    out = _LETTER[np.minimum(points, 0x2FFFF)]
    for i in np.flatnonzero(points > 0x2FFFF).tolist():  # rare: beyond the table
        out[i] = chr(points[i]).isalpha()
    return out


class Bundler:
    """Vectors of texts, a block of texts at a time; keeps n-gram vectors that it made, up to a bound."""

    def __init__(self, n: int, dims: int, keep: int = 30_000) -> None:
        self.n, self.dims, self.keep = n, dims, keep
        self.keys, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.table, self.used = np.zeros((1024, dims), np.float32), 0

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Bind the rotated letter vectors of each n-gram."""
        out = np.ones((len(keys), self.dims), np.int8)
        for place in range(self.n):
            points = (keys >> (21 * (self.n - 1 - place))) & 0x1FFFFF
            own, at = np.unique(points, return_inverse=True)
            out *= np.roll(letter_vectors(own, self.dims), place, axis=1)[at]
        return out.astype(np.float32)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct keys."""
        i = np.searchsorted(self.keys, keys)
        i[i == len(self.keys)] = 0
        missing = keys[self.keys[i] != keys] if len(self.keys) else keys
        if len(missing):
            if self.used + len(missing) > self.keep:
                self.keys, self.at, self.used, missing = self.keys[:0], self.at[:0], 0, keys
            while self.used + len(missing) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(missing)] = self.vectors(missing)
            every = np.concatenate([self.keys, missing])
            order = np.argsort(every, kind="stable")
            self.at = np.concatenate([self.at, np.arange(self.used, self.used + len(missing))])[order]
            self.keys, self.used = every[order], self.used + len(missing)
            i = np.searchsorted(self.keys, keys)
        return self.table[self.at[i]]

    def _add(self, out: np.ndarray, pieces: list[tuple[int, np.ndarray]]) -> None:
        """Add the n-gram vectors of letter runs to their texts' rows."""
        letters = np.concatenate([p for _, p in pieces])
        size = np.array([len(p) for _, p in pieces])
        row = np.repeat(np.arange(len(pieces)), size)
        m = len(letters) - self.n + 1
        whole = row[:m] == row[self.n - 1 :]  # n-grams do not cross texts
        seen = np.bincount(letters)
        points = np.flatnonzero(seen)
        k = len(points)
        if k**self.n <= 1 << 22:
            small = np.zeros(len(seen), np.int64)
            small[points] = np.arange(k)
            ids = small[letters]
            code = np.zeros(m, np.int64)
            for place in range(self.n):
                code = code * k + ids[place : place + m]
            code, row = code[whole], row[:m][whole]
            codes = np.flatnonzero(np.bincount(code, minlength=1))
            column = np.zeros(int(codes[-1]) + 1, np.int64)
            column[codes] = np.arange(len(codes))
            column = column[code]
            keys = np.zeros(len(codes), np.int64)
            for place in range(self.n):
                keys = (keys << 21) | points[codes // k ** (self.n - 1 - place) % k]
        else:
            code = np.zeros(m, np.int64)
            for place in range(self.n):
                code = (code << 21) | letters[place : place + m]
            row = row[:m][whole]
            keys, column = np.unique(code[whole], return_inverse=True)
        order = np.arange(len(row))
        texts = np.array([i for i, _ in pieces])
        for lo in range(0, len(keys), self.keep):
            hi = min(lo + self.keep, len(keys))
            if lo or hi < len(keys):
                order = np.flatnonzero((column >= lo) & (column < hi))
            vectors = self.rows(keys[lo:hi])
            step = max(1, (1 << 22) // (hi - lo))
            for a in range(0, len(pieces), step):
                b = min(a + step, len(pieces))
                on = order[np.searchsorted(row[order], a) : np.searchsorted(row[order], b)]
                counts = np.bincount((row[on] - a) * (hi - lo) + column[on] - lo, minlength=(b - a) * (hi - lo)).reshape(b - a, hi - lo)
                np.add.at(out, texts[a:b], counts.astype(np.float32) @ vectors)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One row for each text; all zeros if it has no letter."""
        out = np.zeros((len(texts), self.dims))
        pieces: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, text in enumerate(texts):
            letters = letters_of(text).astype(np.int64)
            if 0 < len(letters) < self.n:
                letters = np.concatenate([letters, np.full(self.n - len(letters), 32)])
            for lo in range(0, max(0, len(letters) - self.n + 1), _BLOCK):
                pieces.append((i, letters[lo : lo + _BLOCK + self.n - 1]))
                held += len(pieces[-1][1])
                if held >= _BLOCK:
                    self._add(out, pieces)
                    pieces, held = [], 0
        if pieces:
            self._add(out, pieces)
        return out


def fit_prototypes(docs: DataFrame, sample_per_lang: int, n: int, dims: int, max_langs: int = MOST_LANGS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their prototypes; docs: doc_id, text, lang of training rows."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a written table of max_langs rows at most, which is sent to the tasks
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    share = written(counts.select("lang", F.least(F.lit(1.0), sample_per_lang / F.col("n")).alias("share")), "language-shares")
    sampled = docs.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20) < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(n, dims), {}
        for whole in batches:
            for batch in chunks(whole, "text"):
                for v, lang in zip(bundler.bundle(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
                    if size := np.linalg.norm(v):
                        sums[lang] = sums.get(lang, 0) + v / size
        # whole numbers, so that the sum does not depend on the order of tasks
        rows = {lang: np.rint(v * 1e6).astype(np.int64) for lang, v in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([list(range(dims))] * len(rows), pa.list_(pa.int32())), pa.array([v.tolist() for v in rows.values()], pa.list_(pa.int64()))], names=["lang", "at", "v"])

    parts = sampled.select("text", "lang").mapInArrow(run, "lang string, at array<int>, v array<bigint>")
    total = parts.select("lang", F.explode(F.arrays_zip("at", "v")).alias("x")).groupBy("lang", "x.at").agg(F.sum("x.v").alias("v"))
    whole = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("x")).select("lang", "x.v")
    rows = {r.lang: np.array(r.v, np.float64) for r in whole.toLocalIterator()}  # max_langs vectors at most
    langs = sorted(lang for lang, v in rows.items() if np.linalg.norm(v) > 0)
    return langs, np.array([rows[x] / np.linalg.norm(rows[x]) for x in langs]).reshape(len(langs), dims)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, n: int, dims: int) -> DataFrame:
    """lang_pred and score of every row, beside its other columns; score is (1 + cosine) / 2."""
    text_at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        bundler = Bundler(n, dims)
        for whole in batches:
            for batch in chunks(whole, "text"):
                vectors = bundler.bundle(batch.column(text_at).to_pylist()) if names else np.zeros((batch.num_rows, dims))
                size = np.linalg.norm(vectors, axis=1)
                cos = (vectors / np.where(size > 0, size, 1)[:, None]) @ table.T if names else np.zeros((batch.num_rows, 1))
                best = np.argmax(cos, axis=1)
                langs_out = [names[b] if n else "und" for b, n in zip(best.tolist(), size.tolist())]
                scores = np.where(size > 0, np.clip((1 + cos[np.arange(len(best)), best]) / 2, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs_out, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify_language(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, sample_per_lang: int = 4000, n: int = N, dims: int = DIMENSIONS, max_langs: int = MOST_LANGS) -> DataFrame:
    """Learn from the rows where `train` holds; predict all rows: doc_id (or the columns to keep), lang_pred, score."""
    refuse_clash(keep, ("lang_pred", "score"))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), train.alias("train"))
    langs, prototypes = fit_prototypes(rows.where("train"), sample_per_lang, n, dims, max_langs)
    if keep is not None:
        own = docs.select(*(docs[c].alias(f"_{i}") for i, c in enumerate(keep)), docs[text_col].cast("string").alias("text"))
        out = predict(own, langs, prototypes, n, dims)
        return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")
    return predict(rows.select("doc_id", "text"), langs, prototypes, n, dims).select("doc_id", "lang_pred", "score")
