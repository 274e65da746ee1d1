"""Scan boundaries over a table of paths: which paths each inspects, and what several of them cover together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import excluded, glob_regex
from ..functions.text import utf16_key


@dataclass(frozen=True)
class Boundary:
    """One configuration's limits."""

    name: str
    globs: tuple[str, ...] = ("**",)
    exclude: tuple[str, ...] = ()
    max_file_size: int = 512 * 1024
    max_depth: int = 16


def state_in(b: Boundary, path: Column, size: Column) -> Column:
    """too-deep, excluded, not-included, too-large or inspected: the first that holds."""
    depth = F.size(F.split(path, "/")) - 1
    included = F.lit(False)
    for g in b.globs:
        included = included | path.rlike(glob_regex(g))
    return F.when(depth > b.max_depth, "too-deep").when(excluded(path, list(b.exclude)), "excluded").when(~included, "not-included").when(size > b.max_file_size, "too-large").otherwise("inspected")


def union_scan(paths: DataFrame, boundaries: Sequence[Boundary]) -> DataFrame:
    """paths(path, size): (path, inspected, boundaries, states) by name of boundary, decided from paths alone, before any content is read.

    A path is inspected if one boundary inspects it, by that boundary's own rules: patterns are not merged.
    """
    path, size = F.col("path"), F.col("size")
    each = F.array(*(F.struct(F.lit(b.name).alias("boundary"), state_in(b, path, size).alias("state")) for b in boundaries))
    states = paths.select("path", each.alias("s"))
    hit = F.filter("s", lambda x: x["state"] == "inspected")
    return states.select("path", (F.size(hit) > 0).alias("inspected"), F.transform(hit, lambda x: x["boundary"]).alias("boundaries"), F.transform("s", lambda x: x["state"]).alias("states"))


def merged(boundaries: Sequence[Boundary]) -> Boundary:
    """The description of a union: all patterns, the exclusions that all share, the larger limits."""
    key = lambda s: s.encode("utf-16-be")
    common = [x for x in sorted(set(boundaries[0].exclude), key=key) if all(x in b.exclude for b in boundaries)] if boundaries else []
    return Boundary("+".join(b.name for b in boundaries), tuple(sorted({g for b in boundaries for g in b.globs}, key=key)), tuple(common), max((b.max_file_size for b in boundaries), default=0), max((b.max_depth for b in boundaries), default=0))


def trusted_suppressions(before: DataFrame, after: DataFrame, today: str) -> DataFrame:
    """(id, path, reason, expires) of the suppressions (id, path, reason, expires) that are active on both sides, with the stricter end; 'never' is the latest.

    A changed reason does not matter; that of the first side is kept.  Rows that repeat an id and path on a side count as the one that ends last.
    """
    active = lambda df: df.where((F.coalesce("expires", F.lit("never")) == "never") | (F.col("expires") >= today)).withColumn("expires", F.coalesce("expires", F.lit("never")))
    last = F.when(F.col("expires") == "never", F.lit("9999-12-31")).otherwise(F.col("expires"))
    one = active(before).groupBy("id", "path").agg(F.max(F.struct(last.alias("last"), utf16_key(F.col("reason")).alias("k"), "reason")).alias("a"))
    two = active(after).groupBy("id", "path").agg(F.max(last).alias("b"))
    end = F.least("a.last", "b")
    return one.join(two, ["id", "path"]).select("id", "path", F.col("a.reason").alias("reason"), F.when(end == "9999-12-31", "never").otherwise(end).alias("expires"))
