"""Set operations by key and over list values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def added_removed_shared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or shared."""
    both = left.select(key).distinct().withColumn("l", F.lit(True)).join(right.select(key).distinct().withColumn("r", F.lit(True)), key, "full_outer")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").otherwise("shared")
    return both.select(key, change.alias("change"))


def list_delta(old: Column, new: Column) -> tuple[Column, Column]:
    """(added, removed) values of two lists, each sorted and distinct; null is empty."""
    empty = F.array().cast("array<string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.array_sort(F.array_distinct(F.array_except(b, a))), F.array_sort(F.array_distinct(F.array_except(a, b)))
