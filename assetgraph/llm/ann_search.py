"""Nearest neighbours by largest inner product, with an adaptive scan of dimensions.

Vectors get one more component that makes all of them equally long, so the largest
inner product is the smallest distance (a query's own extra component is 0), and are then
turned by a random rotation.  Lists come from k-means centroids fitted on at most
`sample` vectors (a documented bound); every vector is put into the list of its nearest
centroid.  How many lists a query probes is measured on the sample: the fewest that hold
`recall` of the sample's own neighbours (on vectors without clusters that is about half of all lists).

A query first scans its `ahead` nearest lists.  The distance of its worst result so far is handed on to
the rest of its lists.  There, lists that lie beyond it by their radius are left out, and candidates
are scanned in blocks of `block` rotated columns.  After each block a hypothesis test compares
the partial distance with that limit: as the rotation is random, the share of a distance in d of D columns
is beta distributed, with mean d / D and a variance that shrinks as d grows; candidates whose partial distance is more
than `z` deviations above the limit's share are given up and never come back.  Survivors are scored
exactly, in double precision on the original vectors.

Lists are gathered into cells of about `cell_rows` vectors, one task each; a list that is longer is
dealt over several cells.  A query goes to a cell once, whatever number of its lists are there; where there are more than `query_rows` queries,
they are dealt over parts, and a task takes one part of a cell's queries.
Equal vectors form a class and are scanned once; a class knows its `k` + 1 smallest ids,
which is all that any result can hold of it.  So neither one very common vector nor one large list meets in one task.

Vectors that are null, zero, or hold a null or a component that is not finite take no
part, nor do rows with null id.  Vectors are searched among those of their own length.  Rows that repeat an id
count once, with the least of their vectors (component by component).  An empty table gives no rows;
a table of one vector gives none.  Ties go to the smaller id.  Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

MOST_LISTS = 1024
_SCHEMA = "query_id bigint, rank int, vec_id bigint, score double"


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs."""
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 2048) -> np.ndarray:
    """The nearest centroid of each row, some rows at a time."""
    return np.concatenate([np.zeros(0, np.int64), *(np.argmin(distances(x[i : i + rows], c), axis=1) for i in range(0, len(x), rows))])


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(n)[:-1]][some], axis=0)
        c[some] = sums / n[some][:, None]
    return c


def fewest_probes(lifted: np.ndarray, asked: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The least number of nearest lists that hold `recall` of the k nearest sample vectors of the sample's queries."""
    if len(lifted) <= k + 1:
        return len(centroids)
    home = nearest(lifted, centroids)
    far = distances(asked, lifted)
    near = np.argpartition(far, k + 1, axis=1)[:, : k + 1]
    order = np.argsort(distances(asked, centroids), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def most_share(d: int, dims: int, z: float) -> float:
    """The share of a squared distance that d of `dims` randomly rotated columns rarely exceed."""
    return d / dims + z * np.sqrt(2 * d * (dims - d) / (dims * dims * (dims + 2))) if d < dims else 1.0


def adaptive_scan(queries: np.ndarray, rows: np.ndarray, limit: np.ndarray, block: int, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, squared distance) of the pairs that no test gives up; both are rotated.

    While many pairs are left, a block is one matrix product; then the few are followed one by one.
    """
    dims = rows.shape[1]
    partial, alive = np.zeros((len(queries), len(rows))), None
    lo = 0
    while lo < dims:
        hi = min(lo + block, dims)
        partial += distances(queries[:, lo:hi], rows[:, lo:hi])
        bound = limit * most_share(hi, dims, z) * (1 + 1e-9) + 1e-12
        alive = (partial <= bound[:, None]) & (True if alive is None else alive)
        lo = hi
        if np.count_nonzero(alive) < 0.03 * alive.size:
            break
    q, r = np.nonzero(alive)
    left = partial[q, r]
    while lo < dims and len(q):
        hi = min(lo + block, dims)
        left = left + ((queries[q, lo:hi] - rows[r, lo:hi]) ** 2).sum(axis=1)
        on = left <= (limit * most_share(hi, dims, z) * (1 + 1e-9) + 1e-12)[q]
        q, r, left, lo = q[on], r[on], left[on], hi
    return q, r, left


def usable(v: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row for which is_query(id column) holds.

    Options: lists, probes (both chosen if not given), sample, recall, ahead, block, z, cell_rows, query_rows.
    """
    raw = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    good = raw.where("vec_id is not null").where(usable(F.col("v")))
    # -0.0 and 0.0 are one value
    once = good.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    held = written(once.withColumn("dims", F.size("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "ann-vectors")
    lengths = held.groupBy("dims").agg(F.max("norm").alias("norm")).orderBy("dims").collect()  # one row for each length of vectors
    found = [_search(held.where(F.col("dims") == r.dims), r.dims, r.norm, is_query, k, **options) for r in lengths]
    out = vectors.sparkSession.createDataFrame([], _SCHEMA) if not found else found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _search(held: DataFrame, dims: int, norm: float, is_query: Callable[[Column], Column], k: int, lists: int | None = None, probes: int | None = None, sample: int = 20_000, recall: float = 0.95, ahead: int = 4, block: int = 16, z: float = 2.0, cell_rows: int = 16_384, query_rows: int = 16_384) -> DataFrame:
    """search among vectors of one length; norm: the largest squared length."""
    spark = held.sparkSession
    place_in = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    smallest = written(held.select("vec_id", "v").withColumn("r", place_in).where(F.col("r") <= k + 1), "ann-members")
    members = written(smallest.select("vec_id", F.min("vec_id").over(Window.partitionBy("v")).alias("class")), "ann-classes")
    classes = smallest.where("r = 1").select(F.col("vec_id").alias("class"), "v")
    asked_ids = held.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v")
    queries = written(asked_ids.join(classes, "v").select("query_id", F.col("class").alias("qclass")), "ann-queries")
    asked = queries.select(F.col("qclass").alias("class")).distinct().join(classes, "class")
    n, parts = classes.count(), max(1, -(-asked.count() // query_rows))  # no cell is asked by more than all
    share = F.pmod(F.xxhash64(F.lit("fit"), "class"), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20))
    fitted = classes.where(share).select("v").collect() or classes.select("v").limit(1).collect()
    turn = rotation(dims + 1)

    def lifted(x: np.ndarray) -> np.ndarray:
        """Vectors of equal length, rotated."""
        rest = np.sqrt(np.maximum(0.0, norm - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1) @ turn

    def as_query(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1) @ turn

    known = np.array([r.v for r in fitted], np.float64)
    rows = lifted(known)
    centroids = fit_centroids(rows, lists or min(MOST_LISTS, max(16, n // 128)))
    probes = min(len(centroids), probes or fewest_probes(rows, as_query(known[:256]), centroids, k, recall))
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_LISTS rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = lifted(matrix(b.column(1), dims))
                near = nearest(x, shared.value)
                far = np.sqrt(((x - shared.value[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(far)], names=["class", "v", "list", "far"])

    placed = written(classes.select("class", "v").mapInArrow(place, "class bigint, v array<double>, list int, far double"), "ann-lists")
    sizes = {r["list"]: (r.n, r.far) for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    first, pieces, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    cell, room = -1, 0
    for i, (size, far) in sorted(sizes.items()):
        pieces[i], radius[i] = -(-size // cell_rows), far + 1e-9
        if pieces[i] > 1 or size > room:
            cell, room = cell + 1, cell_rows
        first[i], room = cell, room - size
        if pieces[i] > 1:
            cell, room = cell + int(pieces[i]) - 1, 0
    table = F.broadcast(spark.createDataFrame([(i, int(first[i]), int(pieces[i])) for i in sizes], "list int, first long, pieces long"))  # at most MOST_LISTS rows
    rows = placed.join(table, "list").select("class", "v", "list", (F.col("first") + F.pmod(F.xxhash64("class"), F.col("pieces"))).alias("cell"))

    def send(lo: int, hi: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The cells of each query's lists from the lo-th to the hi-th nearest."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
                limit = b.column(2).to_numpy(zero_copy_only=False)
                far = distances(as_query(matrix(b.column(1), dims)), shared.value)
                near = np.argsort(far, axis=1, kind="stable")[:, lo:hi]
                at = np.repeat(np.arange(b.num_rows), near.shape[1])
                own = near.ravel()
                on = (pieces[own] > 0) & (np.sqrt(far[at, own]) - radius[own] <= np.sqrt(limit[at]) + 1e-9)
                at, own = at[on], own[on]
                times = pieces[own]
                at, own, piece = np.repeat(at, times), np.repeat(own, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cells = first[own] + piece
                order = np.lexsort((own, cells, at))
                at, own, cells = at[order], own[order], cells[order]
                new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (cells[1:] != cells[:-1])]) if len(at) else np.zeros(0, np.int64)
                wanted = pa.ListArray.from_arrays(pa.array(np.r_[new, len(at)].astype(np.int32)), pa.array(own.astype(np.int32)))
                took = pa.array(at[new])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(took) for c in range(3)), pa.array(cells[new]), wanted], names=["class", "v", "limit", "cell", "lists"])

        return run

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.sort_by("list").combine_chunks()
            own = matrix(right.column("v").combine_chunks(), dims)
            names, at_list = right.column("class").to_numpy(), right.column("list").to_numpy()
            turned = lifted(own)
            wanted = left.column("lists").combine_chunks()
            asker, list_of = np.repeat(np.arange(left.num_rows), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
            x = matrix(left.column("v").combine_chunks(), dims)
            q, limit = as_query(x), left.column("limit").to_numpy().copy()
            for i in np.unique(list_of):
                a, b = np.searchsorted(at_list, [i, i + 1])
                who = asker[list_of == i]
                step = max(1, (1 << 20) // max(1, b - a))
                for part in (who[s : s + step] for s in range(0, len(who) if b > a else 0, step)):
                    n, r, far = adaptive_scan(q[part], turned[a:b], limit[part], block, z)
                    order = np.lexsort((far, n))
                    n, r, far = n[order], r[order], far[order]
                    rank = np.arange(len(n)) - np.searchsorted(n, n)
                    worst = part[n[rank == k]]  # k + 1 found in this list: none behind the last of them is a result
                    limit[worst] = np.minimum(limit[worst], far[rank == k])
                    on = far <= limit[part[n]] + 1e-9
                    out.append((part[n[on]], r[on] + a, (own[r[on] + a] * x[part[n[on]]]).sum(axis=1)))
            asking = left.column("class").to_numpy()
            n, r, score = (np.concatenate([o[j] for o in out]) for j in range(3))
            order = np.lexsort((-score, n))
            n, r, score = n[order], r[order], score[order]
            start = np.searchsorted(n, n)
            edge = score[np.minimum(start + k, np.searchsorted(n, n, side="right") - 1)]
            on = score >= edge  # the k + 1 best, and what ties with the last of them
            return pa.table({"qclass": pa.array(asking[n[on]]), "class": pa.array(names[r[on]]), "score": pa.array(score[on])})
        return pa.table({"qclass": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def scanned(asking: DataFrame, lo: int, hi: int) -> DataFrame:
        sent = asking.mapInArrow(send(lo, hi), "class bigint, v array<double>, limit double, cell bigint, lists array<int>")
        # a cell's queries are dealt over parts, each of which meets the cell's rows in a task of its own
        dealt = sent.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(parts)))
        met = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))) if parts > 1 else rows.withColumn("part", F.lit(0).cast("long"))
        return dealt.groupBy("cell", "part").cogroup(met.groupBy("cell", "part")).applyInArrow(scan, "qclass bigint, class bigint, score double")

    def best(found: DataFrame) -> DataFrame:
        # ties at the edge of the classes kept can hold smaller ids, so all that tie stay
        return found.withColumn("r", F.rank().over(Window.partitionBy("qclass").orderBy(F.desc("score")))).where(F.col("r") <= k + 1)

    lead = min(ahead, probes)
    found = written(best(scanned(asked.select("class", "v", F.lit(float("inf")).alias("limit")), 0, lead)), "ann-first")
    if probes > lead:
        worst = found.groupBy("qclass").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") > k).select(F.col("qclass").alias("class"), "worst")
        own = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        limit = F.when(F.col("worst").isNull(), float("inf")).otherwise(F.greatest(own + F.lit(norm) - 2 * F.col("worst"), F.lit(0.0)) + 1e-9)
        again = asked.join(worst, "class", "left").select("class", "v", limit.alias("limit"))
        found = best(found.drop("r").unionByName(scanned(again, lead, probes)))
    each = found.drop("r").join(members, "class").withColumn("r", F.row_number().over(Window.partitionBy("qclass").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r", "class")
    hits = queries.join(each, "qclass").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
