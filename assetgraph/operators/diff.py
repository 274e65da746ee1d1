"""Two snapshots side by side: changes by key, relaxations, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import list_delta


def keyed_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): added, removed or changed keys; unchanged ones are left out.  Nulls equal nulls."""
    a = left.select(F.col(key).alias("lk"), *(F.col(f).alias(f"l_{f}") for f in fields))
    b = right.select(F.col(key).alias("rk"), *(F.col(f).alias(f"r_{f}") for f in fields))
    both = a.join(b, F.col("lk") == F.col("rk"), "full_outer")
    shared = F.col("lk").isNotNull() & F.col("rk").isNotNull()
    names = F.concat_ws(",", *(F.when(shared & ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in sorted(fields)))
    change = F.when(F.col("lk").isNull(), "added").when(F.col("rk").isNull(), "removed").when(names != "", "changed")
    return both.select(F.coalesce("lk", "rk").alias(key), change.alias("change"), names.alias("fields")).where("change is not null")


def list_transitions(left: DataFrame, right: DataFrame, key: str, values: str) -> DataFrame:
    """(key, change, value): values added to or removed from each key's list."""
    both = left.select(key, F.col(values).alias("a")).join(right.select(key, F.col(values).alias("b")), key, "full_outer")
    added, removed = list_delta(F.col("a"), F.col("b"))
    both = both.select(key, F.explode(F.array(F.struct(F.lit("added").alias("change"), added.alias("v")), F.struct(F.lit("removed").alias("change"), removed.alias("v")))).alias("x"))
    return both.select(key, "x.change", F.explode("x.v").alias("value"))


def is_relaxation(field: str, old: Column, new: Column) -> Column:
    """An approval that was asked for and is not now; a permission that was denied and is not now.  Null is 'not stated'."""
    if field.startswith("requires_"):
        return F.coalesce(old, F.lit(False)) & ~F.coalesce(new, F.lit(False))
    return ~F.coalesce(old, F.lit(True)) & F.coalesce(new, F.lit(True))


def gate(matches: Column, mode: Column) -> Column:
    """Outcome of a gate: pass without matches or if off, else its mode."""
    return F.when((matches == 0) | (mode == "off"), F.lit("pass")).otherwise(mode)


# Review modes from lax to strict, outcomes from good to bad, and the gates.
MODES = ("off", "warn", "fail")
OUTCOMES = ("pass", "warn", "fail")
GATES = ("security_policy", "scan_boundary", "executable_surface", "quality_policy", "metadata_policy", "skill_discovery")
# Changes of what is scanned that weaken it, as kind:change; all others tighten it.
WEAKENING = ("glob:removed", "exclusion:added", "limit:removed", "limit:lowered", "suppression:added", "suppression:lifetime_extended")


def _two_sides(left: DataFrame, right: DataFrame, key: list[str], how: str = "full_outer") -> DataFrame:
    """The columns of both sides by key, with l_ and r_ before their names; l_is and r_is say where a side has the key."""
    side = lambda df, p: df.select(*key, *(F.col(c).alias(p + c) for c in df.columns if c not in key), F.lit(True).alias(p + "is"))
    return side(left, "l_").join(side(right, "r_"), key, how)


def edge_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): edges added or removed, and edges of the new side newly unresolved (new ones, too) or newly resolved.

    old, new: the key, resolved, and `at`, by which the last of repeated keys stands (a resolved one if equal).
    Keys with a null are not compared.
    """
    last = lambda df: df.dropna(subset=key).groupBy(*key).agg(F.max(F.struct("at", "resolved"))["resolved"].alias("resolved"))
    both = _two_sides(last(old), last(new), key)
    was, now = F.col("l_resolved"), F.col("r_resolved")
    changes = F.array(
        F.when(F.col("l_is").isNull(), "added"), F.when(F.col("r_is").isNull(), "removed"), F.when(~now & F.coalesce(was, F.lit(True)), "newly_unresolved"), F.when(now & ~was, "newly_resolved")
    )
    return both.select(*key, F.explode(F.array_compact(changes)).alias("change"))


def check_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, from_status, to_status, from_severity, to_severity, summary_changed) of the new side's checks that changed; new checks were absent.  old, new: id, status, severity, summary; one row an id."""
    both = _two_sides(old, new, ["id"], "right_outer")
    was = lambda c: F.when(F.col("l_is").isNull(), "absent").otherwise(F.col(f"l_{c}"))
    changed = F.col("l_is").isNull() | ~F.col("l_summary").eqNullSafe(F.col("r_summary"))
    out = both.select("id", *(c for f in ("status", "severity") for c in (was(f).alias(f"from_{f}"), F.col(f"r_{f}").alias(f"to_{f}"))), changed.alias("summary_changed"))
    return out.where("summary_changed or not (from_status <=> to_status) or not (from_severity <=> to_severity)")


def boundary_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, item, change, direction): changes of globs, exclusions, limits (by value) and suppressions (by expiry; null never ends)."""
    both = _two_sides(old, new, ["kind", "item"])
    limit, suppression = F.col("kind") == "limit", F.col("kind") == "suppression"
    never = F.lit("9999-12-31").cast("date")
    was, now = F.coalesce("l_expires", never), F.coalesce("r_expires", never)
    change = (
        F.when(F.col("l_is").isNull(), "added")
        .when(F.col("r_is").isNull(), "removed")
        .when(limit & (F.col("r_value") > F.col("l_value")), "raised")
        .when(limit & (F.col("r_value") < F.col("l_value")), "lowered")
        .when(suppression & (now > was), "lifetime_extended")
        .when(suppression & (now < was), "lifetime_shortened")
    )
    out = both.select("kind", "item", change.alias("change")).where("change is not null")
    return out.withColumn("direction", F.when(F.concat_ws(":", "kind", "change").isin(*WEAKENING), "weakening").otherwise("tightening"))


def threshold_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, from_value, to_value, direction) of thresholds that both sides have and that differ; a higher one is weaker."""
    both = _two_sides(old, new, ["key"], "inner").where("l_value <> r_value")
    direction = F.when(F.col("r_value") > F.col("l_value"), "weakening").otherwise("tightening")
    return both.select("key", F.col("l_value").alias("from_value"), F.col("r_value").alias("to_value"), direction.alias("direction"))


def ci_gates(modes: DataFrame, matches: DataFrame) -> DataFrame:
    """(repo, gate, effective, match_count, outcome) of modes(repo, gate, from, to) and matches(repo, gate, n).

    The stricter mode of the two sides holds, so a change cannot switch off its own review.  Where the mode of the
    metadata or the quality gate itself was relaxed, that is a match more.  The discovery gate warns at most, and has no matches when off.
    """
    rank = lambda c: F.array_position(F.array(*map(F.lit, MODES)), F.col(c))
    soft = F.col("gate") == "skill_discovery"
    top = F.greatest(rank("from"), rank("to"))
    effective = F.element_at(F.array(*map(F.lit, MODES)), F.when(soft, F.least(top, F.lit(2))).otherwise(top).cast("int"))
    relaxed = (F.col("gate").isin("metadata_policy", "quality_policy") & (rank("from") > rank("to"))).cast("long")
    out = modes.join(matches, ["repo", "gate"], "left").select("repo", "gate", effective.alias("effective"), (F.coalesce("n", F.lit(0)) + relaxed).alias("n"))
    count = F.when(soft & (F.col("effective") == "off"), 0).otherwise(F.col("n"))
    return out.select("repo", "gate", "effective", count.cast("long").alias("match_count"), gate(F.col("n"), F.col("effective")).alias("outcome"))


def ci_report(gates: DataFrame) -> DataFrame:
    """(repo, status, matches, open_gates): the worst outcome of a repository's gates, and the names of those that did not pass."""
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    status = F.element_at(F.array(*map(F.lit, OUTCOMES)), F.max(rank).cast("int"))
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") != "pass", F.col("gate")))), ",")
    return gates.groupBy("repo").agg(status.alias("status"), F.sum("match_count").alias("matches"), names.alias("open_gates"))
