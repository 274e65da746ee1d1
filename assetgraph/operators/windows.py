"""Ordinals, look-backs, boundaries and first matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence_ordinal(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The number of each row among those of its key."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def guarded(lines: Column, risky: str, guard: str, back: int = 2) -> Column:
    """(risky lines, those with a guard in them or up to `back` lines before) of an array of lines.

    Look-back stays inside the row, so nothing is shuffled.
    """
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: (i <= F.size(lines)) & F.get(lines, i - 1).rlike(risky))
    near = lambda i: F.slice(lines, F.greatest(i - back, F.lit(1)), i - F.greatest(i - back, F.lit(1)) + 1)
    safe = F.filter(at, lambda i: F.exists(near(i), lambda line: line.rlike(guard)))
    return F.struct(F.size(at).alias("risky"), F.size(safe).alias("guarded"))


def next_boundary(headings: Column) -> Column:
    """For an array of struct(ord, depth): each with the ord of the next heading of no greater depth (null: none)."""
    after = lambda h: F.filter(headings, lambda x: (x["ord"] > h["ord"]) & (x["depth"] <= h["depth"]))
    return F.transform(headings, lambda h: F.struct(h["ord"].alias("ord"), h["depth"].alias("depth"), F.array_min(F.transform(after(h), lambda x: x["ord"])).alias("next_ord")))


def first_match(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
