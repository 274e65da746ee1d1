"""Benchmark decontamination by a prefix-filtered set join.

Words are lower-cased runs of digits, a-z and non-ASCII bytes.  An item's windows are
its runs of 13 consecutive words (a shorter item is one window).  A window is a
set of shingles (five words; all of a window shorter than that), and it must be
contained whole, so its necessary prefix is one shingle: the rarest.  Rarity is
the number of occurrences in all documents, counted in a first pass over the
documents for the benchmark's shingles only.  The second pass joins document
shingles with prefix shingles; the shingle's place in the window gives the only
possible start, which must leave room on both sides (positional and length
bounds), and the window's words are then compared with the document's.

Equal windows of the benchmark are put together first.  If at most `block_windows` are left, standing in at most ten
times as many (window, item) pairs, they are sent to the tasks as one broadcast, and documents are read
twice and never shuffled.  A larger benchmark is joined by shuffles: documents give rows for the shingles that pass a
bitmap (sized by the number of shingles, up to 64 MB), once to count and once to join with the prefixes by hash; only the texts that meet a prefix
are read a third time, to compare words.  Nothing of the benchmark is collected but the bitmap.

A null or empty document has no words and is not contaminated.  A null or empty
item has no window; a null item_id reads as an empty string, and items of equal
id count once.  Rows with equal doc_id are separate documents.  Only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import refuse_clash, written
from .wordhash import LOWER, Words, alnum_table, chunks, hash_words, window_hashes

WINDOW = 13
SHINGLE = 5
_BITS = 22
ROOM = 32  # bits of the bitmap for each shingle, so that one in 32 of others passes
LEAST_BITS, MOST_BITS = 16, 29  # of the bitmap's size: 64 MB at most, which serves 16 million shingles


def _words(column: pa.Array) -> Words:
    return hash_words(column, alnum_table(), LOWER)


def _slots(keys: np.ndarray) -> np.ndarray:
    """Bitmap over the low bits of keys; a quick test before the exact lookup."""
    out = np.zeros(1 << _BITS, bool)
    out[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return out


def _hits(hashes: np.ndarray, whole: np.ndarray, keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose hash is one of the sorted keys, and which."""
    at = np.flatnonzero(slots[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)] & whole)
    key = np.searchsorted(keys, hashes[at])
    key[key == len(keys)] = 0
    same = keys[key] == hashes[at] if len(keys) else np.zeros(len(at), bool)
    return at[same], key[same]


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, length, words, shingles) of every window; shingles are 64-bit hashes by place."""
    items = items.select(F.coalesce(items["item_id"].cast("string"), F.lit("")).alias("item_id"), items["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                w = _words(batch.column(1))
                rows: dict[str, list] = {"item_id": [], "length": [], "words": [], "shingles": []}
                for i, item in enumerate(batch.column(0).to_pylist()):
                    a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                    words = [LOWER[w.raw[s:e]].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b])]
                    length = min(window, len(words))
                    if not length:
                        continue
                    k = min(SHINGLE, length)
                    sh, _ = window_hashes(w.hashes[a:b], np.array([0, b - a]), k)
                    for s in range(len(words) - length + 1):
                        rows["item_id"].append(item)
                        rows["length"].append(length)
                        rows["words"].append(b" ".join(words[s : s + length]))
                        rows["shingles"].append(sh[s : s + length - k + 1].astype(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(rows["item_id"], pa.string()), pa.array(rows["length"], pa.int32()), pa.array(rows["words"], pa.binary()), pa.array(rows["shingles"], pa.list_(pa.int64()))], names=[*rows])

    return items.mapInArrow(run, "item_id string, length int, words binary, shingles array<bigint>")


def _joined(w: Words, a: int, b: int) -> bytes:
    """The words from a to b, lower-cased, with one space between."""
    return b" ".join(LOWER[w.raw[x:y]].tobytes() for x, y in zip(w.starts[a:b], w.ends[a:b]))


def _count_shingles(docs: DataFrame, wanted: dict[int, np.ndarray]) -> DataFrame:
    """(k, shingle, n): occurrences in all documents of the wanted shingles, by shingle length."""
    sizes = sorted(wanted)
    slots = {k: _slots(wanted[k]) for k in sizes}
    shared = docs.sparkSession.sparkContext.broadcast((wanted, slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, quick = shared.value
        total = {k: np.zeros(len(keys[k]), np.int64) for k in sizes}
        for whole in batches:
            for batch in chunks(whole, "text"):
                w = _words(batch.column(0))
                for k in sizes:
                    h, ok = window_hashes(w.hashes, w.bounds, k)
                    _, key = _hits(h, ok, keys[k], quick[k])
                    total[k] += np.bincount(key, minlength=len(keys[k]))
        for k in sizes:
            seen = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(keys[k][seen].astype(np.int64)), pa.array(total[k][seen])], names=["k", "shingle", "n"])

    return docs.select("text").mapInArrow(run, "k int, shingle bigint, n bigint").groupBy("k", "shingle").agg(F.sum("n").alias("n"))


def _merge(starts: np.ndarray, lengths: np.ndarray) -> int:
    """Words covered by the given windows of one document."""
    if not len(starts):
        return 0
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate((starts + lengths)[o])
    before = np.r_[0, e[:-1]]
    return int(np.maximum(0, e - np.maximum(s, before)).sum())


def _small(docs: DataFrame, windows: list) -> DataFrame:
    """(doc_id, n_words, starts, lengths, items) per document for windows that are few; windows: rows (length, words, shingles, items)."""
    sizes = sorted({min(SHINGLE, r.length) for r in windows})
    wanted = {k: np.unique(np.array([s for r in windows if min(SHINGLE, r.length) == k for s in r.shingles], np.int64).astype(np.uint64)) for k in sizes}
    seen = {(r.k, r.shingle): r.n for r in _count_shingles(docs, wanted).collect()}  # at most the shingles of the windows
    prefixes: dict[int, dict[int, list[tuple[int, int, int]]]] = {k: {} for k in sizes}  # shingle -> (place, length, window)
    for i, r in enumerate(windows):
        k = min(SHINGLE, r.length)
        least, place = min((seen.get((k, s), 0), j) for j, s in enumerate(r.shingles))
        if least:  # a window with a shingle that no document has can't occur
            prefixes[k].setdefault(int(np.int64(r.shingles[place]).astype(np.uint64)), []).append((place, r.length, i))
    keys = {k: np.array(sorted(prefixes[k]), np.uint64) for k in sizes}
    entries = {k: [prefixes[k][int(x)] for x in keys[k]] for k in sizes}
    shared = docs.sparkSession.sparkContext.broadcast((keys, {k: _slots(keys[k]) for k in sizes}, entries, [bytes(r.words) for r in windows], [r["items"] for r in windows]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, quick, entries, words, held = shared.value
        for whole in batches:
            for batch in chunks(whole, "text"):
                w = _words(batch.column(1))
                doc_of = w.doc_of()
                starts: list[list[int]] = [[] for _ in range(batch.num_rows)]
                lengths: list[list[int]] = [[] for _ in range(batch.num_rows)]
                items: list[set[str]] = [set() for _ in range(batch.num_rows)]
                for k in keys:
                    h, ok = window_hashes(w.hashes, w.bounds, k)
                    for p, key in zip(*(x.tolist() for x in _hits(h, ok, keys[k], quick[k]))):
                        d = int(doc_of[p])
                        a, b = int(w.bounds[d]), int(w.bounds[d + 1])
                        for place, length, i in entries[k][key]:
                            s = p - place
                            if s < a or s + length > b:
                                continue
                            if _joined(w, s, s + length) == words[i]:
                                starts[d].append(s - a)
                                lengths[d].append(length)
                                items[d].update(held[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(w.bounds)), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "starts", "lengths", "items"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, starts array<bigint>, lengths array<bigint>, items array<string>")


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """A bitmap of about `ROOM` bits for each shingle, at most 2 ** MOST_BITS: the low bits of column `shingle`, packed in bytes."""
    wanted = max(1, shingles.count()) * ROOM
    bits = min(MOST_BITS, max(LEAST_BITS, wanted.bit_length()))
    low = shingles.select((F.col("shingle").bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("low"))  # bit positions count from 1
    rows = low.groupBy(F.bitmap_bucket_number("low").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("low")).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.toLocalIterator():  # at most 2 ** bits / 32768 rows of 4 KB, one partition of them at a time
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _set_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the low bits of each hash are set in a bitmap."""
    low = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


def _passing(rows: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(k, shingle, row, at): the document shingles that pass the bitmap."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                w = _words(batch.column(1))
                doc, row = w.doc_of(), batch.column(0).to_numpy()
                for k in sizes:
                    h, ok = window_hashes(w.hashes, w.bounds, k)
                    at = np.flatnonzero(_set_in(shared.value, h) & ok)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(h[at].astype(np.int64)), pa.array(row[doc[at]]), pa.array(at - w.bounds[doc[at]])], names=["k", "shingle", "row", "at"])

    return rows.select("row", "text").mapInArrow(run, "k int, shingle bigint, row bigint, at bigint")


def _verified(rows: DataFrame, met: DataFrame) -> DataFrame:
    """(row, start, length, words) of the candidates (row, start, length, words) whose words stand there; a text is read once, if it has any."""
    asked = met.groupBy("row").agg(F.collect_set(F.struct("start", "length", "words")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                w = _words(batch.column(1))
                out: list[tuple[int, int, int, str]] = []
                for i, (row, asked) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                    a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                    for c in asked.as_py():
                        s = a + c["start"]
                        if a <= s and s + c["length"] <= b and _joined(w, s, s + c["length"]).decode() == c["words"]:
                            out.append((row, c["start"], c["length"], c["words"]))
                row, start, length, words = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(words, pa.string())], names=["row", "start", "length", "words"])

    return rows.join(asked, "row").select("row", "text", "asked").mapInArrow(run, "row bigint, start bigint, length int, words string")


def _large(docs: DataFrame, windows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Like _small, by shuffles; windows: (length, words, shingles), items: (length, words, item_id).

    Document shingles meet the prefixes by their hashes alone; words are fetched only for those that do.
    """
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "contamination-rows")
    sizes = sorted({min(SHINGLE, r.length) for r in windows.select("length").distinct().collect()})
    k_of = F.least(F.lit(SHINGLE), F.col("length")).alias("k")
    listed = windows.select("length", F.col("words").cast("string").alias("words"), k_of, F.posexplode("shingles").alias("place", "shingle"))
    counted = _passing(rows, _bitmap(listed.select("shingle").distinct()), sizes).groupBy("k", "shingle").agg(F.count("*").alias("n"))
    # the prefix of a window is its rarest shingle; a window with a shingle that no document has can't occur
    ranked = listed.join(counted, ["k", "shingle"], "left").groupBy("length", "words", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle")).alias("p")).where("p.n > 0")
    prefixes = written(ranked.select("length", "words", "k", "p.place", "p.shingle"), "prefixes")
    met = _passing(rows, _bitmap(prefixes.select("shingle").distinct()), sizes).join(prefixes, ["k", "shingle"]).where("at >= place")
    hits = written(_verified(rows, met.select("row", (F.col("at") - F.col("place")).alias("start"), "length", "words")), "window-hits")
    spans = hits.select("row", F.struct("start", F.col("length").cast("long").alias("length")).alias("s")).groupBy("row").agg(F.collect_set("s").alias("s"))
    named = hits.select("row", "length", "words").distinct().join(items.withColumn("words", F.col("words").cast("string")), ["length", "words"])
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = rows.withColumn("n_words", F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))).drop("text").join(spans, "row", "left").join(named, "row", "left")
    some = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), some(F.col("s.start"), "array<bigint>").alias("starts"), some(F.col("s.length"), "array<bigint>").alias("lengths"), some(F.col("items"), "array<string>").alias("items"))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_windows: int = 50_000, min_share: float = 0.05, keep: list[str] | None = None) -> DataFrame:
    """One row per document: its id (or the columns to keep), n_words, n_hit, n_items, items_sha256, contaminated, and the items found."""
    refuse_clash(keep, ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"))
    # the columns to keep go through as one value in the place of the id
    own = docs[id_col] if keep is None else F.struct(*(docs[c].alias(f"_{i}") for i, c in enumerate(keep)))
    docs = docs.select(own.alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(item_windows(items, window), "item-windows")
    windows = found.groupBy("length", "words").agg(F.first("shingles").alias("shingles"))
    pairs = found.select("length", "words", "item_id").distinct()
    if windows.count() <= block_windows and pairs.count() <= 10 * block_windows:
        held = pairs.groupBy("length", "words").agg(F.collect_list("item_id").alias("items"))
        hits = _small(docs, windows.join(held, ["length", "words"]).collect())
    else:
        hits = _large(docs, written(windows, "windows"), pairs, window)
    least = round(1 / min_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = b.column(1).to_numpy()
            n_hit = np.array([_merge(np.array(s, np.int64), np.array(x, np.int64)) if s else 0 for s, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], np.int64)
            names = b.column(4).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array((n_hit > 0) & (least * n_hit >= n_words), pa.bool_()), b.column(4)],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    out = hits.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>")
    return out if keep is None else out.select(*(F.col(f"doc_id._{i}").alias(c) for i, c in enumerate(keep)), *out.columns[1:])
