"""Vectorised word spans and word hashes for Arrow string columns.

All functions work on the UTF-8 bytes of a whole Arrow batch at once, so a task
never builds one Python object per word.  Separators are ASCII in every word
definition used here, hence byte-level scanning of UTF-8 is exact.

A word hash takes the word's bytes eight at a time, each block mixed into the state by a
full-avalanche finaliser, so there is no algebraic family of equal hashes; words of more than
`LONG` bytes are hashed by BLAKE2.  Two independent lanes of 64 bits can be had.  A window's
hash is put together from hashes of windows of one, two, four, ... words, mixed at each step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

CHUNK = 1 << 16  # words hashed at once
LONG = 64  # bytes
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_LANES = (np.uint64(0), np.uint64(0xA0761D6478BD642F))
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (xor-shift-multiply), on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def space_table() -> np.ndarray:
    """Words are runs of bytes other than space and 0x09-0x0D."""
    table = np.ones(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return table


def alnum_table() -> np.ndarray:
    """Words are runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII bytes."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = True
    table[0x41:0x5B] = True
    table[0x61:0x7B] = True
    table[0x80:] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
KEEP = np.arange(256, dtype=np.uint8)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls become empty texts."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1, offset=8 * column.offset) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch of texts: byte spans and hashes (one array for each lane); bounds[i]:bounds[i+1] are text i's."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lanes: list[np.ndarray]
    bounds: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return self.lanes[0]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses a text's end."""
    inside = table[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Hashes of data[starts:ends]; eight bytes follow the last word."""
    length = ends - starts
    blocks = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, 0, (1,))
    out = []
    for lane in range(lanes):
        out.append(mix(length.astype(np.uint64) * _Q + _LANES[lane]))
    left = np.minimum(length, LONG)
    at, on = starts, slice(None)
    while True:
        block = blocks[at] & _MASK[np.minimum(left, 8)]
        for h in out:
            h[on] = mix(h[on] ^ block)
        more = left > 8
        if not more.any():
            break
        on = np.flatnonzero(more) if isinstance(on, slice) else on[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG).tolist():
        whole = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest(), np.uint64)
        for h, value in zip(out, whole):
            h[i] = value
    return out


def hash_words(column: pa.Array, table: np.ndarray, fold: np.ndarray = KEEP, with_hashes: bool = True, lanes: int = 1) -> Words:
    """Words of every text in the column.  fold maps bytes before hashing (LOWER or KEEP)."""
    raw, offsets = string_buffers(column)
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return Words(raw, empty, empty, [np.zeros(0, np.uint64)] * lanes, np.zeros(len(offsets), np.int64))
    starts, ends = _spans(raw, offsets, table)
    bounds = np.searchsorted(starts, offsets)
    hashes = [np.zeros(len(starts) if with_hashes else 0, np.uint64) for _ in range(lanes)]
    if with_hashes and len(starts):
        data = np.zeros(len(raw) + 8, np.uint8)
        np.take(fold, raw, out=data[: len(raw)])
        for lo in range(0, len(starts), CHUNK):
            part = _hash_spans(data, starts[lo : lo + CHUNK], ends[lo : lo + CHUNK], lanes)
            for h, p in zip(hashes, part):
                h[lo : lo + CHUNK] = p
    return Words(raw, starts, ends, hashes, bounds)


def window_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows at every word position, and which positions start a whole window."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    if n >= k:
        power, size, acc, have = hashes, 1, None, 0  # windows of `size` words; acc: of `have` words
        while True:
            if k & size:
                acc = power if acc is None else mix(power[: n - have - size + 1] * _P + acc[size : n - have + 1])
                have += size
            if have == k:
                break
            power = mix(power[: n - 2 * size + 1] * _P + power[size : n - size + 1])
            size *= 2
        out[: n - k + 1] = acc
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    return out, left >= k


def chunks(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of at most about `most` text bytes (one row at least)."""
    i = batch.schema.get_field_index(column)
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    total, lo = np.concatenate([[0], np.cumsum(lengths)]), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
