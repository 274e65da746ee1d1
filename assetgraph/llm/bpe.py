"""Byte-level BPE encoding and decoding with a pair occurrence index.

A text is cut at the special tokens of the vocabulary file and then into words by the file's
pattern.  The words of a task that have not been met before are encoded together, in portions
of at most `PORTION` bytes.  All their symbols lie in one array with links to the next and
previous symbol of a word, and an index maps each pair of neighbours that has a rank to all its positions.  The
active ranks (those of pairs in the index) are applied in ascending order: a rank's positions are
taken from the index and merged from left to right, and the lists of the pairs that the merges make are
extended by them.  Positions that a merge has used up stay in the lists of other pairs and are
skipped when their turn comes.  A rank is applied once, because no merge makes a pair of lower rank; a file
for which that does not hold is refused.  The work is near linear in the bytes, for a word of megabytes too.

Words and their ids are kept for the next texts of the task, up to `KEPT` of them.  Decoding puts the bytes of
the ids together; bytes that are not UTF-8 become U+FFFD.

The file is read on the driver by its path and sent to the tasks; at most `MOST_MERGES` merges are accepted, which
bounds what is sent.  Null and empty texts have no ids and decode to the empty text.  Ids null or
outside the vocabulary are left out in decoding.  Rows are independent, so nothing is shuffled: null and
repeated ids of documents stay as they are, and empty tables give empty tables.  A text is cut where white space begins
into pieces of about a megabyte, so a very long text needs memory for its bytes and ids only.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import chunks

MOST_MERGES = 1_000_000
KEPT = 100_000  # words whose ids a task remembers
WORDS = 1 << 17  # words that wait for their ids at most (one piece of a text at least)
PORTION = 1 << 20  # bytes of new words that are encoded together (one word at least)
MANY = 48  # positions that are merged together; fewer are merged one by one
PIECE = 1 << 20  # characters of a text that are cut into words together

# Letters and numbers that the pattern's engine does not know yet (assigned after Unicode 16.0).
LATER_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    "\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATER_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
_PLAIN = regex.compile(PATTERN.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))
_L, _N = rf"[\p{{L}}--[{LATER_LETTERS}]]", rf"[\p{{N}}--[{LATER_NUMBERS}]]"
_EXACT = regex.compile("(?V1)" + PATTERN.replace(r"[^\s{L}{N}]", rf"[^\s[{_L}][{_N}]]").replace("{L}", _L).replace("{N}", _N))
_LATER = re.compile(f"[{LATER_LETTERS}{LATER_NUMBERS}]")
_CUT = regex.compile(r"\S(?=\s)")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a vocabulary file: itself if it is visible, else one from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = itertools.count(0x100)
    return [chr(b) if b in set(seen) else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """What encoding and decoding need of a vocabulary file."""

    first: np.ndarray  # id of each byte
    ranks: dict[int, int]  # left id << 32 | right id -> rank
    merges: list[tuple[int, int, int]]  # by rank: left id, right id, new id
    byte_ranks: np.ndarray  # rank of each pair of bytes, or -1
    keys: np.ndarray  # the keys of `ranks`, sorted, and their ranks
    key_ranks: np.ndarray
    special: dict[str, int]
    data: bytes  # bytes of all tokens
    starts: np.ndarray  # of each id in data, and the end; ids without a token are empty


def read_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file (JSON with a vocabulary and merges in order of rank)."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    model, split = raw["model"], raw.get("pre_tokenizer") or {}
    odd = model.get("type") != "BPE" or raw.get("normalizer") or raw.get("post_processor") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
    if odd or any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges")):
        raise ValueError("not a plain byte-level BPE file")
    ids, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(pairs) > MOST_MERGES:
        raise ValueError(f"more than {MOST_MERGES} merges")
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(merges)}
    made = {new: rank for rank, (_, _, new) in enumerate(merges)}
    if len(ranks) != len(pairs) or len(made) != len(pairs) or any(max(made.get(a, -1), made.get(b, -1)) >= rank for rank, (a, b, _) in enumerate(merges)):
        raise ValueError("a merge uses a token that a later or another merge makes")
    letters = byte_letters()
    byte_of = {c: b for b, c in enumerate(letters)}
    special = {t["content"]: t["id"] for t in raw.get("added_tokens") or []}
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in raw.get("added_tokens") or []):
        raise ValueError("special tokens that take in what stands beside them")
    size = max([*ids.values(), *special.values()]) + 1
    tokens = [b""] * size
    for token, i in itertools.chain(ids.items(), special.items()):
        tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    first = np.array([ids[c] for c in letters], np.int32)
    byte_ranks = np.array([ranks.get(a << 32 | b, -1) for a in first.tolist() for b in first.tolist()], np.int32)
    keys = np.array(sorted(ranks), np.int64)
    return Vocabulary(first, ranks, merges, byte_ranks, keys, np.array([ranks[k] for k in keys.tolist()], np.int32), special, b"".join(tokens), np.cumsum([0, *map(len, tokens)]))


class _Index:
    """The pair occurrence index: for each active rank, the positions of its pair."""

    def __init__(self) -> None:
        self.where: dict[int, array] = {}
        self.active: list[int] = []

    def add(self, rank: int, i: int) -> None:
        at = self.where.get(rank)
        if at is None:
            at = self.where[rank] = array("i")
            heapq.heappush(self.active, rank)
        at.append(i)

    def add_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order].astype(np.int32)
        cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]) if len(ranks) else ranks
        for rank, lo, hi in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(ranks)]):
            at = self.where.get(rank)
            if at is None:
                at = self.where[rank] = array("i")
                heapq.heappush(self.active, rank)
            at.frombytes(places[lo:hi].tobytes())

    def pop(self) -> tuple[int, array]:
        rank = heapq.heappop(self.active)
        return rank, self.where.pop(rank)


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, the end of each word's)."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    n, ends = len(raw), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    symbol = array("i", v.first[raw].tobytes())
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    S, A, B = (np.frombuffer(x, np.int32) for x in (symbol, after, before))  # the same memory
    A[ends - 1] = -1
    B[ends[:-1]] = -1
    index, ranks = _Index(), v.ranks
    pairs = v.byte_ranks[raw[:-1].astype(np.int32) * 256 + raw[1:]]
    at = np.flatnonzero((pairs >= 0) & (A[:-1] >= 0))
    index.add_all(pairs[at], at)
    while index.active:
        rank, places = index.pop()
        left, right, new = v.merges[rank]
        if len(places) >= MANY and left != right:
            _merge_many(S, A, B, np.frombuffer(places, np.int32), left, right, new, index, v)
            continue
        for i in sorted(places) if left == right else places:
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # used up by an earlier merge
            k = after[j]
            symbol[i], symbol[j], after[i], after[j] = new, -1, k, -1
            if k >= 0:
                before[k] = i
                made = ranks.get(new << 32 | symbol[k])
                if made is not None:
                    index.add(made, i)
            h = before[i]
            if h >= 0:
                made = ranks.get(symbol[h] << 32 | new)
                if made is not None:
                    index.add(made, h)
    left = np.flatnonzero(S >= 0)
    return S[left], np.searchsorted(left, ends)


def _merge_many(S: np.ndarray, A: np.ndarray, B: np.ndarray, i: np.ndarray, left: int, right: int, new: int, index: _Index, v: Vocabulary) -> None:
    """Merge a pair of two different symbols at all its positions; no two of them share a symbol."""
    i = i[S[i] == left]
    j = A[i]
    i, j = i[j >= 0], j[j >= 0]
    on = S[j] == right
    i, j = i[on], j[on]
    k = A[j]
    S[i], S[j], A[i], A[j] = new, -1, k, -1
    goes = k >= 0
    B[k[goes]] = i[goes]
    h = B[i]
    comes = h >= 0
    comes[comes] = S[h[comes]] != new  # else it is the pair after h, which is there already
    key = np.concatenate([(np.int64(new) << 32) + S[k[goes]], (S[h[comes]].astype(np.int64) << 32) + new])
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    known = v.keys[at] == key
    index.add_all(v.key_ranks[at[known]], np.concatenate([i[goes], h[comes]])[known])


def _may_be_later(text: str) -> bool:
    """False for Latin texts, at the price of a copy."""
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return True


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text without special tokens, a piece of it at a time."""
    lo = 0
    while lo < len(text):
        cut = _CUT.search(text, lo + PIECE) if len(text) - lo > PIECE else None
        hi = cut.end() if cut else len(text)
        piece = text[lo:hi] if hi - lo < len(text) else text
        yield (_EXACT if _may_be_later(piece) and _LATER.search(piece) else _PLAIN).findall(piece)
        lo = hi


class Encoder:
    """Encodes texts, and remembers words."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.ids, self.starts = v, {}, array("i"), array("q", [0])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True)))) if v.special else None

    def _forget(self) -> None:
        self.known, self.ids, self.starts = {}, array("i"), array("q", [0])

    def _learn(self, words: list[str]) -> None:
        lo = 0
        data = [w.encode() for w in words]
        while lo < len(data):
            hi, size = lo, 0
            while hi < len(data) and (hi == lo or size + len(data[hi]) <= PORTION):
                size += len(data[hi])
                hi += 1
            ids, ends = merge_words(data[lo:hi], self.v)
            self.known.update(zip(words[lo:hi], range(len(self.starts) - 1, len(self.starts) + hi - lo - 1)))
            self.starts.frombytes((ends + len(self.ids)).astype(np.int64).tobytes())
            self.ids.frombytes(ids.tobytes())
            lo = hi

    def _ids(self, words: list[str]) -> np.ndarray:
        """The ids of words that are known."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        starts, ids = np.frombuffer(self.starts, np.int64), np.frombuffer(self.ids, np.int32)
        length = starts[at + 1] - starts[at]
        first = np.cumsum(length) - length
        return ids[np.repeat(starts[at] - first, length) + np.arange(int(length.sum()))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; new words of all of them are encoded together."""
        out: list[list] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        new: set[str] = set()

        def settle() -> None:
            self._learn(list(new))
            for i, words in waiting:
                out[i].append(self._ids(words))
            waiting.clear()
            new.clear()
            if len(self.known) > KEPT or len(self.ids) > 8 * KEPT:
                self._forget()

        size = 0
        for i, text in enumerate(texts):
            lo = 0
            for m in itertools.chain(self.cut.finditer(text) if self.cut else (), (None,)):
                for words in words_of(text[lo : m.start()] if m else text[lo:] if lo else text):
                    waiting.append((i, words))
                    new.update(set(words).difference(self.known))
                    size += len(words)
                    if size > WORDS:
                        settle()
                        size = 0
                if m:
                    settle()
                    size, lo = 0, m.end()
                    out[i].append(np.array([self.v.special[m.group()]], np.int32))
        settle()
        return [np.concatenate(parts) if parts else np.zeros(0, np.int32) for parts in out]


def decode_ids(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The text of ids in UTF-8."""
    ids = ids[(ids >= 0) & (ids < len(v.starts) - 1)]
    data = np.frombuffer(v.data, np.uint8)
    length = v.starts[ids + 1] - v.starts[ids]
    first = np.cumsum(length) - length
    raw = data[np.repeat(v.starts[ids] - first, length) + np.arange(int(length.sum()))].tobytes()
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def encode_bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of each text; with decode also `decoded`, the text that the ids stand for."""
    v = read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for whole in batches:
            for b in chunks(whole, "text", 2 << 20):
                ids = encoder.encode([t or "" for t in b.column(1).to_pylist()])
                offsets = np.cumsum([0, *map(len, ids)])
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                columns = [b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
                if decode:
                    columns.append(pa.array([decode_ids(x, v) for x in ids], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])
            pa.default_memory_pool().release_unused()  # workers are used again, and their memory adds up

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>{', decoded string' if decode else ''}")


def decode_bpe(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the text that each row's ids stand for."""
    v = read_vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = (np.zeros(0, np.int64) if not s.is_valid else s.values.fill_null(-1).to_numpy(zero_copy_only=False) for s in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(r, v) for r in rows], pa.binary()).cast(pa.string())], names=["doc_id", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {kind}, decoded string")
