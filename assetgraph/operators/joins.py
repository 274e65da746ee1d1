"""Reference resolution, ownership, conflicts, suppressions and allow-lists as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import glob_regex, has_owner


def resolve_references(refs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """refs(ref) against targets(id, keys...): state resolved, ambiguous or missing, the number of candidates and the only one.

    A reference matches a target by any of the keys; a target that matches by several is one candidate.
    """
    named = [targets.select(F.col(k).cast("string").alias("ref"), "id") for k in keys]
    every = named[0]
    for n in named[1:]:
        every = every.unionByName(n)
    found = every.where("ref is not null").distinct().groupBy("ref").agg(F.count("*").alias("candidates"), F.min("id").alias("only"))
    out = refs.join(found, "ref", "left")
    n = F.coalesce("candidates", F.lit(0))
    state = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("missing")
    return out.withColumn("candidates", n.cast("long")).withColumn("state", state).withColumn("only", F.when(n == 1, F.col("only")))


def effective_owner(assets: DataFrame, parents: DataFrame) -> DataFrame:
    """assets(id, parent, owner) with parents(parent, parent_owner): the declared owner, else that of the only parent.

    No parent, several parents, or one without an owner leave the asset unowned.
    """
    only = parents.groupBy("parent").agg(F.count("*").alias("n"), F.min("parent_owner").alias("parent_owner"))
    out = assets.join(only, "parent", "left")
    inherited = (F.coalesce("n", F.lit(0)) == 1) & has_owner(F.col("parent_owner"))
    source = F.when(has_owner(F.col("owner")), "declared").when(inherited, "inherited").otherwise("unowned")
    value = F.when(source == "declared", F.trim("owner")).when(source == "inherited", F.trim("parent_owner"))
    return out.select("id", value.alias("effective_owner"), source.alias("owner_source"))


def unknown_references(edges: DataFrame, targets: DataFrame, column: str, key: str) -> DataFrame:
    """Edges whose target does not exist; a null target is unknown."""
    return edges.join(targets.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def orphans(assets: DataFrame, key: str, edges: DataFrame, column: str) -> DataFrame:
    """Assets that no edge refers to."""
    return assets.join(edges.select(F.col(column).alias(key)).distinct(), key, "left_anti")


def conflict_pairs(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, n): unordered pairs of different items that share a group, and in how many groups they do."""
    m = members.select(group, item).where(F.col(item).isNotNull()).distinct()
    left, right = m.withColumnRenamed(item, "a"), m.withColumnRenamed(item, "b")
    return left.join(right, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def apply_suppressions(findings: DataFrame, rules: list[tuple[str, str, str | None]], today: str) -> DataFrame:
    """findings(rule_id, path) with rules (id, path pattern, last day): adds `suppressed_by`, the first matching rule's number.

    A rule is in force through its last day; an expired one suppresses nothing.
    """
    match = F.lit(None).cast("int")
    for i, (rule, pattern, last) in reversed(list(enumerate(rules))):
        if last is not None and last < today:
            continue
        match = F.when((F.col("rule_id") == rule) & F.col("path").rlike(glob_regex(pattern)), F.lit(i)).otherwise(match)
    return findings.withColumn("suppressed_by", match)


def destination_allowed(host: Column, path: Column, allowed: list[str]) -> Column:
    """Host equals an entry or is below it; an entry with a path asks for the same host and that path or one below it.

    Addresses and names without a dot match by equality only.
    """
    out = F.lit(False)
    for entry in allowed:
        name, _, prefix = entry.lower().partition("/")
        if prefix:
            want = "/" + prefix.rstrip("/")
            out = out | ((host == name) & ((path == want) | path.startswith(want + "/")))
        elif name.replace(".", "").isdigit() or "." not in name:
            out = out | (host == name)
        else:
            out = out | (host == name) | (host.endswith("." + name) & ~host.rlike(r"^[0-9.]+$"))
    return F.coalesce(out, F.lit(False))
