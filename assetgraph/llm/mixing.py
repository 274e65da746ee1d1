"""Mixing sources to target weights with a time-varying curriculum.

Targets: sources in code-point order (null last) have base weights 5, 2, 1,
repeating; together they share `share` times the size of all documents (size:
words in the text).  A target stops at `most` times its source's size; the
excess goes to the others by weight until none is above.

Curriculum: over training time t in [0, 1] a source's weight is
base * (1 + ramp * (2t - 1)), with ramps that rise for later sources, scaled so
that its integral over [0, 1], the horizon, is the source's target.  A source's documents lie end to
end in an order drawn by hash, again and again; the word at cumulative offset x
is needed at the time t at which the source's integrated weight schedule reaches
x.  That inverse has a closed form here, and gives each copy of a document its
training position.  A copy takes part if its position lies before the horizon, and
gives the words that are needed until then; what the mix takes of a document
is the sum over its copies.  Results are range-sorted by position.

Running sums (over sources and over documents) need no single task: rows are range-sorted,
each range sums up its own, and one number for each range is shared.  So a source, an id or
a set of equal rows of any size is split over ranges.

Null or empty texts have size 0 and are never taken.  Rows with equal ids are
documents of their own; rows of equal id, source and size can be swapped for each other, so reruns
agree.  Null sources form one source.  Only id, text and source are read; other columns can be kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import refuse_clash, written

WORD = r"[^\x20\x09-\x0D]+"
# The weights of sources in their order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sums(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """df (written, range-sorted by `order`) with a column for each of `values`: the sum of a bigint column over all rows before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    names = [f"_{c}" for c in values]
    schema = T.StructType([*ranged.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])
    at = [ranged.columns.index(c) for c in values.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [0] * len(at)
        for b in batches:
            added = []
            for i, c in enumerate(at):
                up = before[i] + np.cumsum(b.column(c).to_numpy())
                added.append(pa.array(np.r_[before[i], up[:-1]].astype(np.int64)))
                before[i] = int(up[-1]) if len(up) else before[i]
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *added], names=schema.names)

    held = written(ranged.mapInArrow(run, schema), "ranges")
    parts = held.groupBy("_part").agg(*(F.sum(c).alias(c) for c in values.values()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = parts.select("_part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"base_{name}") for name, c in values.items()))
    out = held.join(F.broadcast(parts), "_part")
    return out.select(*df.columns, *((F.col(f"_{c}") + F.col(f"base_{c}")).alias(c) for c in values))


def source_weights(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank, before, weight): one row per source; before: the words of the sources before it."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    src = running_sums(src, ["last", "source"], {"rank": "one", "before": "source_size"})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    return src.select("source", "source_size", "rank", "before", weight.alias("weight"))


def water_level(src: DataFrame, share: float, most: float) -> float:
    """The words per unit of weight at which sources below their cap are filled.

    With the sources sorted by cap for each unit of weight, the first ones are full.  Running sums give the level
    for each number of full ones; it is right where the next source is not above its cap.
    """
    sums = src.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    if not sums["all"]:
        return 0.0
    ratio = F.lit(most) * F.col("source_size") / F.col("weight")
    by_cap = src.select(ratio.alias("ratio"), "rank", "source_size", F.col("weight").cast("long").alias("w"))
    by_cap = running_sums(by_cap, ["ratio", "rank"], {"full": "source_size", "filled": "w"})
    level = (F.lit(share * sums["all"]) - F.lit(most) * F.col("full")) / (F.lit(sums.w) - F.col("filled"))
    found = by_cap.where(level <= F.col("ratio")).agg(F.min_by(level, F.struct("ratio", "rank"))).first()[0]
    return float("inf") if found is None else found


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, ramp: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, its source's size and target, rank, row, offset in the source, copies (position, words) and `kept`, the columns to keep.

    position is the time in [0, 1] at which the source's integrated weight schedule asks for the
    copy's first word: with m = ramp of the source, the share asked for by time t is (1 - m) * t + m * t * t.
    """
    kept = [] if keep is None else [F.struct(*(docs[c].alias(f"_{i}") for i, c in enumerate(keep))).alias("kept")]
    sizes = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(docs[text_col].cast("string")).alias("size"), *kept)
    sizes = written(sizes.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")  # texts are read once
    src = written(source_weights(sizes.select("source", "size")), "mix-sources")
    target = F.least(F.lit(water_level(src, share, most)) * F.col("weight"), F.lit(most) * F.col("source_size"))
    key = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    src = src.select(key[0].alias("k1"), key[1].alias("k2"), "source_size", "rank", "before", target.alias("target"))
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string")))
    rows = sizes.withColumns({"k1": key[0], "k2": key[1], "order": order}).join(src, ["k1", "k2"]).drop("k1", "k2")
    rows = running_sums(rows.drop("kept"), ["rank", "order", "doc_id", "size", "row"], {"start": "size"})
    rows = rows.withColumn("offset", F.col("start") - F.col("before")).withColumn("goal", F.round("target").cast("long"))
    m = F.lit(ramp) * (F.pmod(F.col("rank"), F.lit(3)) - 1)

    def position(x: Column) -> Column:
        part = x / F.col("goal")
        return F.when(m == 0, part).otherwise((F.sqrt((1 - m) * (1 - m) + 4 * m * part) - (1 - m)) / (2 * F.when(m != 0, m)))

    starts = F.transform(F.sequence(F.lit(0), F.lit(int(np.ceil(most)) - 1)), lambda lap: lap * F.col("source_size") + F.col("offset"))
    starts = F.when(F.col("size") > 0, F.filter(starts, lambda x: x < F.col("goal"))).otherwise(F.array().cast("array<bigint>"))
    copies = F.transform(starts, lambda x: F.struct(position(x).alias("position"), F.least("size", F.col("goal") - x).alias("words")))
    out = rows.select("doc_id", "source", "size", "source_size", "target", "rank", "row", "offset", copies.alias("copies"))
    return out.join(sizes.select("row", "kept"), "row") if kept else out  # kept columns hold texts, so they take no part in the sums


def schedule(mix: DataFrame) -> DataFrame:
    """(position, doc_id, source, copy, words) of every copy, range-sorted by position; mix: what plan_mix gives."""
    out = mix.select("doc_id", "source", "size", "row", F.posexplode("copies").alias("copy", "c"))
    out = out.select("c.position", "doc_id", "source", "copy", "c.words", "size", "row")
    return out.repartitionByRange("position", "row").sortWithinPartitions("position", "row", "copy").drop("row")


def scheduled_mix(docs: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """One row per document: doc_id (or the columns to keep), size, source_size, target, taken (words of its copies), position (of its first copy).

    Range-sorted by position.  A document without a copy has 0 taken and no position, and comes first.
    """
    results = ("size", "source_size", "target", "taken", "position")
    refuse_clash(keep, results)
    mix = plan_mix(docs, keep=keep, **options)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c.words)
    out = mix.withColumn("taken", taken).withColumn("position", F.try_element_at("copies", F.lit(1))["position"])
    out = out.repartitionByRange("position", "row").sortWithinPartitions("position", "row")
    own = ["doc_id"] if keep is None else [F.col(f"kept._{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*own, *results)
