"""Ranked lexical search: variable-block-max WAND over shards of documents.

Documents are cut into shards of about `SHARD` bytes of text, in the order in which a task reads them.  A
shard's postings of the queries' terms are lists in order of the documents, each posting with its whole score.  A
list is divided into blocks whose ends dynamic programming chooses: of all divisions into blocks of at most `LONGEST` postings
it takes one with the least sum of bound errors (the block's largest score less the posting's, over all postings) plus
`COST` list maxima for each block.

A search first adds the largest scores of the query's lists; if they cannot reach the tenth best score so far, the limit, the shard is
left at once.  Else the maxima of the blocks that hold a document add up to its bound.  Documents with bounds at the limit or above are the pivots; all
between them are skipped, and blocks without a pivot are never opened.  The pivots with the largest bounds are scored first, which raises the limit, then the rest
in order of documents, in growing steps; after each step pivots below the new limit are given up.  Skipped documents have scores below the
tenth best of the same task, so the result is exact.  The best results and their limit go on from shard to shard of a task, and the
tasks' results (k for each query and task) are merged by a ranking window that cuts to k rows before its shuffle.

Two passes read the texts: one counts documents, words and the queries' document frequencies, one builds and
searches the shards.  Postings are never shuffled, so a term that every document holds costs no more than its own postings.
Queries are taken in blocks of `most_terms` (term, query) rows, each sent to the tasks as a list of that size at most, so any number of queries
can be asked: every block reads the documents again.  Terms are compared by 128-bit hashes.

Null texts hold no term and are no document of the counts; empty texts neither.  A query without terms has no
rows.  Rows of queries that repeat an id are one query with the terms of all; a null id is an id of its own.  Rows of documents that repeat an id are documents of
their own (equal ones are ranked in any order: they look alike).  Null document ids rank last among equal scores.  An empty table on either
side gives no rows.  Only ids and texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .wordhash import LOWER, alnum_table, chunks, hash_words

SHARD = 16 << 20  # bytes of text
LONGEST = 64  # postings in a block
COST = 0.5  # bound error, in list maxima, that a further block must save


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, high, low): each query's different terms, by both halves of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                w = hash_words(b.column(1), alnum_table(), LOWER, lanes=2)
                at = pa.array(w.doc_of())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array(h.view(np.int64)) for h in w.lanes)], names=["item_id", "high", "low"])

    kind = queries.schema[id_col].dataType.simpleString()
    rows = queries.select(queries[id_col].alias("item_id"), queries[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, high bigint, low bigint").distinct()


class Terms:
    """A bounded list of terms, found again by their hashes."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.high, self.low = high, low  # distinct pairs, sorted by both

    def find(self, lanes: list[np.ndarray]) -> np.ndarray:
        """The number of each word's term, or -1."""
        if not len(self.high):
            return np.full(len(lanes[0]), -1)
        high, low = (h.view(np.int64) for h in lanes)
        out = np.full(len(high), -1)
        first = np.searchsorted(self.high, high)
        for step in range(int(np.unique(self.high, return_counts=True)[1].max())):  # more than one where two terms share a half
            at = np.minimum(first + step, len(self.high) - 1)
            out = np.where((self.high[at] == high) & (self.low[at] == low), at, out)
        return out


def postings(column: pa.Array, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; term, text and frequency of each posting, by term and text)."""
    w = hash_words(column, alnum_table(), LOWER, lanes=2)
    found = terms.find(w.lanes)
    on = found >= 0
    n = len(w.bounds) - 1
    key, tf = np.unique(found[on] * max(n, 1) + w.doc_of()[on], return_counts=True)
    return np.diff(w.bounds), key // max(n, 1), key % max(n, 1), tf


def count_terms(docs: DataFrame, terms: Terms) -> DataFrame:
    """(term, n): document frequencies; term -1 counts documents with a term, -2 all terms of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, words = np.zeros(len(terms.high), np.int64), 0, 0
        for whole in batches:
            for b in chunks(whole, "text"):
                length, term, _, _ = postings(b.column(0), terms)
                df += np.bincount(term, minlength=len(df))
                n, words = n + int((length > 0).sum()), words + int(length.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, some]), pa.array(np.r_[n, words, df[some]])], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def block_ends(scores: np.ndarray, bounds: np.ndarray, longest: int = LONGEST, cost: float = COST) -> np.ndarray:
    """Where blocks end, as places in `scores`; bounds[i]:bounds[i+1] is list i.

    Dynamic programming over all lists at once, the longest first: least[i] is the least cost of a list's first i postings, over all
    lengths of the last block.
    """
    sizes = np.diff(bounds)
    ends = []
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    for lo in range(0, len(order), 2048):
        lists = order[lo : lo + 2048]
        begin, size = bounds[lists], sizes[lists]
        top = np.maximum.reduceat(scores, bounds[:-1][np.sort(lists)])[np.argsort(np.argsort(lists))] if len(lists) else np.zeros(0)
        fee = np.maximum(cost * top, 1.0)
        longest_here = int(size[0])
        most = min(longest, longest_here)
        peak = np.zeros((len(lists), most))  # peak[:, k]: largest of the k + 1 postings up to here
        total = np.zeros((len(lists), most))  # and their sum
        least = np.full((len(lists), longest_here + most), np.inf)  # most infinite columns stand before the first posting
        least[:, most - 1] = 0.0
        back = np.zeros((len(lists), longest_here), np.int16)
        length = np.arange(1, most + 1)
        for i in range(longest_here):
            live = int(np.searchsorted(-size, -i, side="left"))  # lists with more than i postings stand first
            s = scores[begin[:live] + i].astype(np.float64)[:, None]
            peak[:live, 1:] = np.maximum(peak[:live, :-1], s)
            total[:live, 1:] = total[:live, :-1] + s
            peak[:live, :1], total[:live, :1] = s, s
            all_costs = least[:live, i : i + most][:, ::-1] + length * peak[:live] - total[:live]
            best = np.argmin(all_costs, axis=1)
            back[:live, i] = best
            least[:live, i + most] = all_costs[np.arange(live), best] + fee[:live]
        at = size - 1
        rows = np.arange(len(lists))
        while len(rows):
            ends.append(begin[rows] + at[rows])
            at[rows] -= back[rows, at[rows]] + 1
            rows = rows[at[rows] >= 0]
    return np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)


class Shard:
    """Posting lists of some documents, divided into blocks."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, score: np.ndarray, n_terms: int, n_docs: int):
        self.doc, self.score, self.n_docs = doc, score, n_docs
        self.bounds = np.searchsorted(term, np.arange(n_terms + 1))
        ends = block_ends(score, self.bounds)
        self.block_of_list = np.searchsorted(ends, self.bounds)
        self.block_start = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        self.block_size = ends + 1 - self.block_start
        self.block_first, self.block_last = doc[self.block_start], doc[ends]
        self.block_max = np.maximum.reduceat(score, self.block_start) if len(ends) else np.zeros(0, np.int64)
        lists = np.flatnonzero(np.diff(self.bounds))
        self.list_max = np.zeros(n_terms, np.int64)
        if len(lists):
            self.list_max[lists] = np.maximum.reduceat(score, self.bounds[:-1][lists])

    def scores_of(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Whole scores of documents (sorted), from those of the blocks that hold one of them."""
        seen = np.zeros(self.n_docs + 1, np.int64)
        seen[docs + 1] = 1
        seen = np.cumsum(seen)
        blocks = blocks[seen[self.block_last[blocks] + 1] > seen[self.block_first[blocks]]]
        size = self.block_size[blocks]
        first = np.cumsum(size) - size
        at = np.repeat(self.block_start[blocks] - first, size) + np.arange(int(size.sum()))
        return np.bincount(self.doc[at], self.score[at].astype(np.float64), self.n_docs)[docs].astype(np.int64)  # sums below 2**53

    def search(self, terms: np.ndarray, limit: int, k: int, best: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all documents that can be among the k best; `best` holds the k largest scores so far, sorted."""
        none = np.zeros(0, np.int64)
        if not len(terms) or int(self.list_max[terms].sum()) < limit:
            return none, none
        first, last = self.block_of_list[terms], self.block_of_list[terms + 1]
        size = last - first
        blocks = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        most = self.block_max[blocks].astype(np.float64)
        rise = np.bincount(self.block_first[blocks], most, self.n_docs + 1) - np.bincount(self.block_last[blocks] + 1, most, self.n_docs + 1)
        bound = np.cumsum(rise)[:-1]
        pivots = np.flatnonzero(bound >= limit)
        docs, scores, step = [], [], 2 * k
        while len(pivots):
            if step == 2 * k and len(pivots) > step:  # those with the largest bounds
                chosen = np.zeros(len(pivots), bool)
                chosen[np.argpartition(bound[pivots], len(pivots) - step)[len(pivots) - step :]] = True
                now, pivots = pivots[chosen], pivots[~chosen]
            else:
                now, pivots = pivots[:step], pivots[step:]
            total = self.scores_of(now, blocks)
            good = total >= limit
            docs.append(now[good])
            scores.append(total[good])
            best += total[good].tolist()
            best.sort(reverse=True)
            del best[k:]
            if len(best) == k and best[-1] > limit:
                limit = best[-1]
                pivots = pivots[bound[pivots] >= limit]
            step *= 4
        return (np.concatenate(docs), np.concatenate(scores)) if docs else (none, none)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about `SHARD` bytes of text (one row at least)."""
    held, size = [], 0
    for whole in batches:
        for b in chunks(whole, "text", SHARD):
            if held and size + b.nbytes > SHARD:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(b)
            size += b.nbytes
    if held:
        yield pa.Table.from_batches(held)


def search_shards(docs: DataFrame, terms: Terms, counts: dict[int, int], items: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of every item."""
    n_docs, words = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([weight(n_docs, counts[t]) if counts.get(t) else 0 for t in range(len(terms.high))], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[int]] = [[] for _ in items]
        found: list[list[tuple[int, int | None]]] = [[] for _ in items]
        for table in _shards(batches):
            column = table.column("text").combine_chunks()
            ids = table.column("doc_id")
            # in the order of ids, null last
            order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
            ids = ids.to_pylist()
            length, term, doc, tf = postings(column, terms)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            m = 100 - 90 + np.array([90 * n * n_docs // words for n in length.tolist()], np.int64) if words else np.zeros(len(length), np.int64)
            score = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            doc = place[doc]
            by = np.lexsort((doc, term))
            shard = Shard(term[by], doc[by], score[by], len(terms.high), len(order))
            for i, (_, own) in enumerate(items):
                limit = max(best[i][-1], 1) if len(best[i]) == k else 1
                at, scores = shard.search(own, limit, k, best[i])
                if len(at):
                    found[i] += zip(scores.tolist(), (ids[order[d]] for d in at))
                    found[i].sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
                    del found[i][k:]
        rows = [(items[i][0], d, s) for i, rows in enumerate(found) for s, d in rows]
        item, doc_id, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_terms: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 for each query."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    asked = query_terms(queries, item_col, item_text)
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("n"))
    # a query's block: running numbers of terms over queries in the order of ids, by ranges
    numbered = written(_in_blocks(sizes, most_terms), "search-items")
    terms_of = written(asked.join(numbered, asked["item_id"].eqNullSafe(numbered["item_id"])).select("block", "item", "high", "low"), "search-terms")
    out = None
    for block in [r.block for r in numbered.select("block").distinct().orderBy("block").collect()]:  # one row for each most_terms terms
        rows = terms_of.where(F.col("block") == block).select("item", "high", "low").toPandas()  # at most most_terms rows, or one query
        both, inverse = np.unique(rows[["high", "low"]].to_numpy(np.int64), axis=0, return_inverse=True)
        terms = Terms(both[:, 0].copy(), both[:, 1].copy())
        items = [(int(i), inverse.ravel()[at]) for i, at in rows.groupby("item").indices.items()]
        counts = {r.term: r.n for r in count_terms(docs, terms).collect()}  # a row for each term of the block
        part = search_shards(docs, terms, counts, items, k)
        out = part if out is None else out.unionByName(part)
    kind = queries.schema[item_col].dataType.simpleString()
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered, "item").select("item_id", "rank", "doc_id", "score")


def _in_blocks(sizes: DataFrame, most_terms: int) -> DataFrame:
    """(item_id, item, block): queries numbered, and dealt to blocks of at most about most_terms terms."""
    spark = sizes.sparkSession
    rows = written(sizes.withColumn("item", F.monotonically_increasing_id()), "search-sizes")
    total = rows.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if not total.n:
        return spark.createDataFrame([], rows.drop("n").withColumn("block", F.lit(0).cast("long")).schema)
    blocks = -(-total.n // most_terms)
    if blocks == 1:
        return rows.select("item_id", "item", F.lit(0).cast("long").alias("block"))
    # by hash into buckets of few queries; a bucket's terms stay below most_terms on average by a margin of a half
    return rows.select("item_id", "item", F.pmod(F.xxhash64("item"), F.lit(2 * blocks)).alias("block"))
