"""Quality selection by importance resampling.

Two generative models over hashed word n-grams (one and two words, `buckets` buckets each
text's n-grams fall into): the target model from texts labelled good, the raw model from
all texts.  A text's log importance weight is the sum over its n-grams of
log(target / raw).  Adding Gumbel noise (drawn by hashing the id, so reruns agree) and
taking the `share` of texts of largest key samples without replacement in proportion to
the weights.

The raw model counts all documents.  The target model is a classifier's side: it uses at
most about `max_labels` labelled rows, chosen by a hash of the id.  The k-th largest key
is found by counting in ever narrower ranges, so keys are never sorted in one task.

Null and empty texts have weight 0 (no n-gram).  All rows come back, with their weight, key
and whether they are selected; keys equal to the smallest selected are selected
as well.  Rows with equal ids are weighed each and share their noise.  Null ids are
one id.  Without target labels all weights are 0.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .wordhash import LOWER, chunks, hash_words, space_table, window_hashes

BUCKETS = 10_000


def _features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram and the text it belongs to, one- and two-word n-grams."""
    w = hash_words(column, space_table(), LOWER)
    two, ok = window_hashes(w.hashes, w.bounds, 2)
    doc = w.doc_of()
    h = np.concatenate([w.hashes, two[ok]])
    return (h % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[ok]])


def count_model(docs: DataFrame, buckets: int) -> np.ndarray:
    """Counts of hashed n-grams over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for b in chunks(whole, "text"):
                total += np.bincount(_features(b.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets)
    for r in rows:  # one row for each bucket
        out[r.bucket] = r.n
    return out


def threshold(keys: DataFrame, k: int, bins: int = 2048) -> float:
    """The k-th largest value of column `key`, by counts in ever narrower ranges."""
    if k < 1:
        return float("inf")
    ends = keys.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).first()
    if not ends.n or k >= ends.n:
        return float("-inf")
    lo, hi, left = ends.lo, ends.hi, k
    while lo < hi:
        width = (hi - lo) / bins
        place = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)).cast("int")
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        rows = sorted(((r.b, r.n, r.lo, r.hi) for r in inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()), reverse=True)
        for _, n, a, b in rows:
            if left <= n:
                lo, hi = a, b
                break
            left -= n
    return lo


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_labels: int = 50_000, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, key, selected."""
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    n = good.count()
    if n > max_labels:
        good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_labels / n * (1 << 20)))
    target = count_model(docs.join(F.broadcast(good), "doc_id", "left_semi"), buckets)
    raw = count_model(docs, buckets)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets)) if target.any() else np.zeros(buckets)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                bucket, doc = _features(b.column(1), buckets)
                weight = np.bincount(doc, weights=shared.value[bucket], minlength=b.num_rows).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.bincount(doc, minlength=b.num_rows).astype(np.int64)), pa.array(weight)], names=["doc_id", "n_grams", "log_weight"])

    weighed = docs.mapInArrow(run, f"doc_id {kind}, n_grams bigint, log_weight double")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed = written(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(u))), "quality-keys")
    k = int(weighed.count() * share)
    return weighed.withColumn("selected", F.col("key") >= threshold(weighed, k))
