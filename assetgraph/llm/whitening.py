"""Whitening of embeddings by a tiled covariance.

An entry c becomes the integer x = floor(64 * c) + 1000000, and the fit list holds each distinct x vector once.
The fit list is cut into row blocks of `ROWS` vectors and each of these into column blocks of `TILE` dimensions.
A pair of column blocks (i <= j) is a tile of the covariance.  Column blocks are shuffled by row block, where each meets the
others of its rows; each pair of them is multiplied, centred, to a part of its tile.  Parts are summed for each tile, once inside
each task and once more after a shuffle by tile, as a stream.  Only the finished tiles go to the driver: dimensions squared numbers, whatever
the number of rows.  There they are put together and split into eigenvectors, which are sent to the tasks that project the rows.  The covariance of the projected
fit list is measured in a pass of its own.

Sums of x are exact integers, so the mean and `deviation` have no rounding; a deviation that a long cannot hold is null.

Rows whose vector is null or empty, or holds a null or a component that is not finite, are dropped.  Vectors of
different lengths are whitened among those of their own length.  Entries beyond +-2**46 count as that.  Repeated vectors are in the fit
list once, so a vector that a third of all rows hold has no weight of its own; each row has its results.  Ids can be null or
repeat.  A component whose eigenvalue is not above 1e-11 of the largest has no variance to divide by and is left out; so
one vector, or none, gives no rows.  Vectors of more than `MOST_DIMS` dimensions are refused: their covariance would not fit the driver.  Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SHIFT, SCALE = 1_000_000, 64
ROWS = 4096  # vectors in a row block
TILE = 128  # dimensions in a column block
MOST_DIMS = 8192
LEAST_SHARE = 1e-11  # of the largest eigenvalue
_FAR = 2.0**46
_HELD = 64 << 20  # bytes of tiles that a task sums up before it hands them on


def whole_entries(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the rows that take part, with integer entries."""
    v = F.col("v")
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    usable = F.coalesce((F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), c * SCALE))).cast("long") + SHIFT)
    return rows.where(usable).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), dims)
            parts = pa.array([len(x)]), *(pa.array([p.sum(axis=0).tolist()], pa.list_(pa.int64())) for p in (x >> 32, x & 0xFFFFFFFF))  # two halves, neither of which can overflow in a batch
            yield pa.RecordBatch.from_arrays(list(parts), names=["n", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "n bigint, high array<bigint>, low array<bigint>")
    each = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "s"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = each.groupBy("dim").agg(F.sum("n").alias("n"), exact("s.high").alias("high"), exact("s.low").alias("low")).orderBy("dim").collect()  # a row for each dimension
    return rows[0].n if rows else 0, [(int(r.high) << 32) + int(r.low) for r in rows]


def centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in doubles: the whole part of the mean is taken off as an integer."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([s % n / n for s in sums])


def column_blocks(fit: DataFrame, dims: int) -> DataFrame:
    """(block, col, size, data): row blocks of the fit list, a row for each of their column blocks; `size` bytes hold an entry without the shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                x = _matrix(b.column(0).slice(lo, ROWS), dims) - SHIFT
                size = next(s for s in (2, 4, 8) if s == 8 or int(np.abs(x).max()) < 1 << (8 * s - 1))
                cols = range(0, dims, TILE)
                data = [np.ascontiguousarray(x[:, c : c + TILE], f"<i{size}").tobytes() for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(cols)), pa.array([c // TILE for c in cols], pa.int32()), pa.array([size] * len(cols), pa.int32()), pa.array(data, pa.binary())], names=["block", "col", "size", "data"])
                block += 1

    return fit.select("x").mapInArrow(run, "block bigint, col int, size int, data binary")


def tile_sums(blocks: DataFrame, dims: int, n: int, sums: list[int]) -> DataFrame:
    """(i, j, data): the sum of each tile i <= j of centred products."""

    def width(c: int) -> int:
        return min(TILE, dims - c * TILE)

    def batch(tiles: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        keys = list(tiles)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([tiles[k].tobytes() for k in keys], pa.binary())], names=["i", "j", "data"])

    def add(tiles: dict[tuple[int, int], np.ndarray], key: tuple[int, int], part: np.ndarray) -> None:
        tiles[key] = tiles[key] + part if key in tiles else part

    def piece(raw: pa.Buffer, size: int, col: int) -> np.ndarray:
        x = np.frombuffer(raw, f"<i{size}").reshape(-1, width(col)).astype(np.int64) + SHIFT
        return centre(x, n, sums[col * TILE : col * TILE + width(col)])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, size, left, right in zip(*(c.to_pylist() for c in b.columns[:3]), *b.columns[3:]):
                add(tiles, (i, j), piece(left.as_buffer(), size, i).T @ piece(right.as_buffer(), size, j))
                if len(tiles) * TILE * TILE * 8 > _HELD:
                    yield batch(tiles)
                    tiles = {}
        if tiles:
            yield batch(tiles)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, part in zip(*b.columns):
                add(tiles, (i.as_py(), j.as_py()), np.frombuffer(part.as_buffer(), np.float64).reshape(width(i.as_py()), width(j.as_py())))
        if tiles:
            yield batch(tiles)

    left = blocks.select("block", F.col("col").alias("i"), "size", F.col("data").alias("left"))
    right = blocks.select("block", F.col("col").alias("j"), F.col("data").alias("right"))
    pairs = left.join(right.hint("merge"), "block").where("i <= j").select("i", "j", "size", "left", "right")
    ddl = "i int, j int, data binary"
    return pairs.mapInArrow(multiply, ddl).repartition("i", "j").mapInArrow(total, ddl)


def covariance(fit: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of the fit list, divisor n, put together from its tiles."""
    v = np.zeros((dims, dims))
    for t in tile_sums(column_blocks(fit, dims), dims, n, sums).toLocalIterator():
        i, j = t.i * TILE, t.j * TILE
        tile = np.frombuffer(t.data, np.float64).reshape(min(TILE, dims - i), -1) / n
        v[i : i + tile.shape[0], j : j + tile.shape[1]] = tile
        v[j : j + tile.shape[1], i : i + tile.shape[0]] = tile.T
    return v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit vectors (columns), without those that have no variance."""
    e, w = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[(e[order] > 0) & (e[order] > LEAST_SHARE * e.max())]
    e, w = e[order], w[:, order]
    return e, w * np.where(w[np.argmax(np.abs(w), axis=0), np.arange(w.shape[1])] < 0, -1.0, 1.0)


def identity_error(fit: DataFrame, dims: int, n: int, sums: list[int], scaled: np.ndarray) -> float:
    """Largest absolute entry of the projected fit list's covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, products = np.zeros(scaled.shape[1]), np.zeros((scaled.shape[1],) * 2)
        for b in batches:
            y = centre(_matrix(b.column(0), dims), n, sums) @ scaled
            own, products = own + y.sum(axis=0), products + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([own.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], names=["own", "products"])

    parts = fit.select("x").mapInArrow(run, "own array<double>, products array<double>")
    k = scaled.shape[1]
    each = parts.select(F.posexplode(F.concat("own", "products")).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()  # k + k * k rows
    found = np.array([r.v for r in each])
    mean = found[:k] / n  # of vectors that are centred: rounding only
    return float(np.abs(found[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n * x - sums)^2; null where a long cannot hold one."""
    whole = np.array([s // n for s in sums], np.int64)
    far = int(np.abs(x - whole).max(initial=0)) + 1
    if far * n < 2**31 and x.shape[1] * (far * n) ** 2 < 2**63:
        d = (x - whole) * n - np.array([s % n for s in sums], np.int64)
        return (d * d).sum(axis=1).tolist()
    out = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [d if d < 2**63 else None for d in out]


def _whiten(rows: DataFrame, fit: DataFrame, dims: int, most: int) -> DataFrame | None:
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} dimensions: more than {MOST_DIMS}")
    n, sums = fit_sums(fit, dims)
    if not n:
        return None
    v = covariance(fit, dims, n, sums)
    e, w = components(v, most)
    if not len(e):
        return None
    scaled, explained = w / np.sqrt(e), (e / np.trace(v)).tolist()
    error, k = identity_error(fit, dims, n, sums, scaled), len(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                x = _matrix(b.column(1), dims)
                y = (centre(x, n, sums) @ scaled).ravel()
                at = np.repeat(np.arange(len(x)), k)
                columns = [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(at)), pa.array(y), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component up to `most`."""
    rows = whole_entries(vectors, id_col, vector_col)
    fit = written(rows.select(F.size("x").alias("dims"), "x").distinct(), "whitening-fit")
    lengths = [r.dims for r in fit.select("dims").distinct().orderBy("dims").collect()]  # one row for each length of vectors
    parts = (_whiten(rows.where(F.size("x") == d), fit.where(F.col("dims") == d), d, most) for d in lengths)
    found = [p for p in parts if p is not None]
    if not found:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
