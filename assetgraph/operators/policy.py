"""Effective policies along profile chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written


def nearest(*levels: Column) -> Column:
    """A tri-state value: the nearest level that states one; null if none does."""
    return F.coalesce(*levels)


def fail_closed(local: Column, valid: Column, inherited: Column, permission: bool = True) -> Column:
    """A local value wins; an invalid one keeps only the safe inherited value (denied permission, asked-for approval)."""
    safe = F.when(inherited == F.lit(not permission), inherited)
    return F.when(~valid, safe).otherwise(F.coalesce(local, inherited))


def accumulate(*lists: Column) -> Column:
    """Values of all levels, sorted and distinct."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(x, empty) for x in lists))))


def profile_chain(profiles: DataFrame) -> DataFrame:
    """profiles(name, parent): (name, chain, state) with the chain from the root, of any depth.

    A missing parent or a cycle breaks the chain: it is empty, and the state says so.  A round takes
    the chains that go on one profile up, and is written; rounds end when none goes on.
    """
    empty = F.array().cast("array<string>")
    up = written(profiles.select(F.col("name").alias("up"), F.col("parent").alias("above")), "profiles")
    open_ = written(profiles.select("name", F.col("parent").alias("next"), F.array("name").alias("chain")), "chains")
    done = open_.where("next is null").select("name", "chain", F.lit("complete").alias("state"))
    open_ = open_.where("next is not null")
    while not open_.isEmpty():
        met = open_.join(up, F.col("next") == F.col("up"), "left")
        state = F.when(F.col("up").isNull(), "missing").when(F.array_contains("chain", F.col("up")), "cycle").when(F.col("above").isNull(), "complete")
        step = written(met.select("name", F.col("above").alias("next"), F.concat(F.array("next"), "chain").alias("chain"), state.alias("state")), "chains")
        ended = step.where("state is not null").select("name", F.when(F.col("state") == "complete", F.col("chain")).otherwise(empty).alias("chain"), "state")
        done, open_ = done.unionByName(ended), step.where("state is null").drop("state")
    return done
