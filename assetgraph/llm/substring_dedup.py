"""Removal of repeated word windows, found level by level with doubling lengths.

A window of `length` words is removed from a document if the same words also
start in a document with a smaller id.  A window can only repeat if each shorter
window in it does.  So every window names one short window in it (the one of
`first` words with the smallest hash, so equal windows name equal ones), and only
windows whose short window is repeated go on: to a window of twice that length around
it, then twice that, until `length` itself.  Each level sees what the last one left, and
the levels end when no candidate is left.

Before the first level, whole texts are compared: a row whose text also stands under a smaller
id loses all of its windows, and takes no part in what follows (the smaller id stands for it).

Rows are dealt into batches of about `batch_bytes` by a number of their own, so equal rows
spread, and written once, bucketed by batch: no level shuffles texts.  At each level a batch
asks for its distinct windows, one row for each, so rows grow with the data; a passage
that a third of all documents hold is one row for each batch.  Spark compares the
rows of equal windows: "another batch has it" or, at the last level, "a smaller id has it".
What is true of a window goes back to its batch as one row.  The candidates that are left and the
answers of every level are written, so nothing is worked out twice and a lost executor costs a level.

Words are runs of other than space and 0x09-0x0D, unchanged.  Windows are compared by 128-bit hashes
at the last level (no algebraic family of equal ones), by 64 bits before, where a chance match
only keeps a candidate.  Null and empty texts have no words.  Rows with null id are kept whole and
remove nothing elsewhere.  Rows with equal ids do not remove each other's words.  Any
bigint is an id.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written, written_by
from .wordhash import Words, hash_words, space_table, window_hashes

FIRST = 4
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 50_000


def level_lengths(length: int, first: int = FIRST) -> list[int]:
    """first, 2 * first, 4 * first, ... and length itself as the last."""
    out = [min(first, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def named_places(hashes: np.ndarray, bounds: np.ndarray, length: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of `length` words, and where in each its named short window (of least hash) is."""
    _, ok = window_hashes(hashes, bounds, length)
    at = np.flatnonzero(ok)
    short, _ = window_hashes(hashes, bounds, first)
    best = short[at]
    place = np.zeros(len(at), np.uint8 if length < 256 else np.int64)
    for j in range(1, length - first + 1):
        other = short[at + j]
        less = other < best
        best[less] = other[less]
        place[less] = j
    return at, place


def around(place: np.ndarray, m: int, length: int, first: int) -> np.ndarray:
    """Where in its window the window of m words around the named one starts.

    It starts or ends with the named one where that fits, so that all windows that share a
    named one ask for two windows of m words at most.
    """
    place = place.astype(np.int64)
    return np.maximum(0, np.where(place > length - m, place - (m - first), place))


class State:
    """What is left of a batch: candidate starts (of `words` words), their named places, and the numbers of rows that are whole copies."""

    def __init__(self, words: int, at: np.ndarray, place: np.ndarray, copies: np.ndarray) -> None:
        self.words, self.at, self.place, self.copies = words, at, place, copies

    def keep(self, which: np.ndarray) -> State:
        return State(self.words, self.at[which], self.place[which], self.copies)

    def packed(self) -> bytes:
        mask = np.zeros(self.words, bool)
        mask[self.at] = True
        head = np.array([self.words, len(self.at), len(self.copies), self.place.itemsize], np.int64)
        return head.tobytes() + self.copies.astype(np.int64).tobytes() + np.packbits(mask).tobytes() + self.place.tobytes()

    @staticmethod
    def unpacked(data: bytes) -> State:
        words, n, copies, item = np.frombuffer(data, np.int64, 4).tolist()
        bits = -(-words // 8)
        mask = np.unpackbits(np.frombuffer(data, np.uint8, bits, 32 + 8 * copies), count=words)
        place = np.frombuffer(data, np.uint8 if item == 1 else np.int64, n, 32 + 8 * copies + bits)
        return State(words, np.flatnonzero(mask), place, np.frombuffer(data, np.int64, copies, 32))


class Batch:
    """A batch's rows in memory: ids (with a mask for null) and words."""

    def __init__(self, table: pa.Table, lanes: int) -> None:
        table = table.sort_by("number").combine_chunks()  # the same order at every level
        ids = table.column("doc_id")
        self.numbers = table.column("number").to_numpy()
        self.text = _one(table.column("text"))
        # filled before they leave Arrow: large ids do not survive as floats
        self.has_id, self.ids = ids.is_valid().to_numpy().astype(bool), ids.fill_null(0).to_numpy().astype(np.int64)
        self.words: Words = hash_words(self.text, space_table(), lanes=lanes)
        self.doc = self.words.doc_of()

    def windows(self, m: int, lane: int) -> np.ndarray:
        return window_hashes(self.words.lanes[lane], self.words.bounds, m)[0]


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def distinct_least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of key pairs (n x 2): the distinct ones in order, their least id, whether two ids have them, and the distinct place of each row."""
    order = _order(keys)
    k, d = keys[order], ids[order]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)]) if len(k) else np.zeros(0, np.int64)
    of = np.zeros(len(k), np.int64)
    of[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(k)]))
    if not len(k):
        return k, d, np.zeros(0, bool), of
    least = np.minimum.reduceat(d, new)
    return k[new], least, np.maximum.reduceat(d, new) != least, of


def _order(keys: np.ndarray) -> np.ndarray:
    """Sorts pairs; by the first alone, unless pairs that share it differ in the second."""
    order = np.argsort(keys[:, 0])
    k = keys[order]
    same = k[1:, 0] == k[:-1, 0]
    return np.lexsort((keys[:, 1], keys[:, 0])) if (same & (k[1:, 1] != k[:-1, 1])).any() else order


class Asked:
    """The distinct windows of m words around the candidates' named ones."""

    def __init__(self, batch: Batch, state: State, lengths: list[int], i: int) -> None:
        first, length, m = lengths[0], lengths[-1], lengths[i]
        start = state.at + around(state.place, m, length, first)
        mask = np.zeros(len(batch.doc), bool)
        mask[start] = True
        places = np.flatnonzero(mask)  # candidates that share a named window share these
        keys = np.zeros((len(places), 2), np.uint64)
        keys[:, 0] = batch.windows(m, 0)[places]
        if i == len(lengths) - 1:  # the second half is 0 before the last level
            keys[:, 1] = batch.windows(m, 1)[places]
        self.ids = batch.ids[batch.doc[places]]
        self.at_place = (np.cumsum(mask) - 1)[start] if len(start) else start
        self.keys, self.least, self.several, self.of = distinct_least(keys, self.ids)

    def of_candidates(self, of_keys: np.ndarray) -> np.ndarray:
        """What is true of the distinct windows, for each candidate."""
        return of_keys[self.of][self.at_place]


_LEVEL = "batch bigint, h1 bigint, h2 bigint, least bigint, state binary"
_OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start: bigint, end: bigint>>"


def _level_rows(number: int, keys: np.ndarray, least: np.ndarray, state: State) -> pa.Table:
    """A row for each distinct window asked for; and one with the candidates, whose `least` is their number."""
    n = len(keys)
    h1, h2 = (pa.array(np.r_[keys[:, i], np.uint64(0)].view(np.int64)) for i in (0, 1))
    held = pa.array([None] * n + [state.packed()], pa.binary())
    return pa.table({"batch": pa.array(np.full(n + 1, number, np.int64)), "h1": h1, "h2": h2, "least": pa.array(np.r_[least, len(state.at)].astype(np.int64)), "state": held})


def _told(answers: pa.Table) -> tuple[State | None, np.ndarray]:
    """The candidates, and the windows (n x 2) of which the answer is yes."""
    answers = answers.combine_chunks()
    held = _one(answers.column("state"))
    at = held.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    state = State.unpacked(held.drop_null()[0].as_py()) if at.any() else None
    yes = np.stack([answers.column(c).to_numpy()[~at].astype(np.int64).view(np.uint64) for c in ("h1", "h2")], axis=1)
    return state, yes


def _is_in(keys: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """Which of the sorted distinct keys are among the distinct yes."""
    if not len(keys) or not len(yes):
        return np.zeros(len(keys), bool)
    yes = yes[_order(yes)]
    if (yes[1:, 0] == yes[:-1, 0]).any():  # a chance match of the first halves
        listed = set(map(tuple, yes.tolist()))
        return np.array([tuple(k) in listed for k in keys.tolist()])
    at = np.minimum(np.searchsorted(yes[:, 0], keys[:, 0]), len(yes) - 1)
    return (yes[at] == keys).all(axis=1)


def _copies(rows: DataFrame) -> DataFrame:
    """(batch, h1): the numbers of the rows whose text also stands under a smaller id.

    Rows of one text come together by batch first, which needs no shuffle; so a text of very many rows is one row for each batch.
    """
    texts = rows.where("doc_id is not null and text is not null").select("batch", "number", "doc_id", F.sha2("text", 256).alias("key"))
    per = texts.groupBy("batch", "key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most"), F.collect_list(F.struct("doc_id", "number")).alias("held"))
    per = per.withColumn("least", F.min("first").over(Window.partitionBy("key"))).where("most > least")
    return per.select("batch", "least", F.inline("held")).where("doc_id > least").select("batch", F.col("number").alias("h1"))


def _ask(lengths: list[int], i: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Level i of one batch: what the last answer leaves, and the windows to ask for."""
    first, length, last = lengths[0], lengths[-1], i == len(lengths) - 1

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table, 2 if last else 1)
        state, yes = _told(answers)
        if i == 0:
            at, place = named_places(batch.words.hashes, batch.words.bounds, length, first)
            copies = yes[:, 0].view(np.int64) if len(yes) else np.zeros(0, np.int64)
            on = (batch.has_id & ~np.isin(batch.numbers, copies))[batch.doc[at]]
            state = State(len(batch.doc), at[on], place[on], copies)
        else:
            before = Asked(batch, state, lengths, i - 1)
            state = state.keep(before.of_candidates(before.several | _is_in(before.keys, yes)))
        now = Asked(batch, state, lengths, i)
        return _level_rows(key[0].as_py(), now.keys, now.least, state)

    return run


def _finish(lengths: list[int]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Remove the words covered by windows that start under a smaller id."""
    length = lengths[-1]

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(table, 2)
        state, yes = _told(answers)
        change = np.zeros(len(batch.doc) + 1, np.int64)
        if len(state.at):
            asked = Asked(batch, state, lengths, len(lengths) - 1)
            start = state.at[asked.of_candidates(_is_in(asked.keys, yes)) | (batch.ids[batch.doc[state.at]] > asked.of_candidates(asked.least))]
            np.add.at(change, start, 1)
            np.add.at(change, start + length, -1)
        gone = np.cumsum(change)[:-1] > 0
        bounds = batch.words.bounds
        gone |= (np.isin(batch.numbers, state.copies) & (np.diff(bounds) >= length))[batch.doc]
        removed, kept, spans = [], [], []
        for i, text in enumerate(batch.text.to_pylist()):
            own_words = gone[bounds[i] : bounds[i + 1]]
            words = (text or "").encode().split()
            edge = np.flatnonzero(np.diff(np.r_[False, own_words, False].astype(np.int8)))
            removed.append(int(own_words.sum()))
            kept.append(b" ".join(compress(words, (~own_words).tolist()) if len(edge) else words).decode())
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        ids = pa.array(batch.ids, mask=~batch.has_id)
        return pa.table({"doc_id": ids, "n_words": pa.array(np.diff(bounds)), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, span)})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, first: int = FIRST, batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the kept words, one space between), spans removed (word places, end exclusive)."""
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    batches = max(1, -(-size // batch_bytes))
    buckets = min(MOST_BUCKETS, max(-(-size // BUCKET_BYTES), min(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    # rows are told apart by a number that is drawn once: the table is written before anything else reads it
    numbered = docs.withColumn("number", F.monotonically_increasing_id())
    rows = written_by(numbered.withColumn("batch", F.pmod(F.xxhash64("number"), F.lit(batches))), "repeats", "batch", buckets)
    lengths = level_lengths(length, first)
    held = F.lit(None).cast("binary").alias("state")
    answers = written(_copies(rows), "copies").select("batch", "h1", F.lit(0).cast("long").alias("h2"), held)
    for i, m in enumerate(lengths):
        level = written(rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_ask(lengths, i), _LEVEL), f"repeats-{m}")
        states, asked = level.where("state is not null"), level.where("state is null")
        same = Window.partitionBy("h1", "h2")
        if m == length:
            told = asked.select("batch", "h1", "h2", "least", F.min("least").over(same).alias("first")).where("least > first")
        else:
            told = asked.select("batch", "h1", "h2", F.count("*").over(same).alias("n")).where("n > 1")
        answers = told.select("batch", "h1", "h2", held).unionByName(states.select("batch", "h1", "h2", "state"))
        if not states.agg(F.sum("least")).first()[0]:
            break
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_finish(lengths), _OUT)
