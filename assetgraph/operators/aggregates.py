"""Coverage, posture, scores and gate composition as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import SEVERITIES, STATUSES, has_owner, name_at, rank_of
from ..functions.text import percent


def coverage(assets: DataFrame, by: str, owner: Column) -> DataFrame:
    """total, owned, unowned and percent owned for each group."""
    n, owned = F.count("*"), F.count_if(has_owner(owner))
    return assets.groupBy(by).agg(n.alias("total"), owned.alias("owned"), (n - owned).alias("unowned"), percent(owned, n).alias("owned_percent"))


def posture(findings: DataFrame) -> DataFrame:
    """findings(finding_id, severity): count and highest severity of each id."""
    worst = name_at(F.max(rank_of(F.col("severity"), SEVERITIES)), SEVERITIES)
    return findings.groupBy("finding_id").agg(F.count("*").alias("n"), worst.alias("max_severity"))


def top_ids(summary: DataFrame, k: int = 10) -> DataFrame:
    """The k ids of most findings; ties by severity, then id."""
    return summary.orderBy(F.desc("n"), rank_of(F.col("max_severity"), SEVERITIES).desc(), "finding_id").limit(k)


def zero_filled(counts: DataFrame, key: str, names: list[str], value: str = "n") -> DataFrame:
    """One row for each name, with 0 where counts has none."""
    listed = counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias(key))
    return listed.join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).alias(value))


def worst_status(outcomes: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """fail over warn over pass."""
    return outcomes.groupBy(*by).agg(name_at(F.max(rank_of(F.col(status), STATUSES)), STATUSES).alias(status))


def stricter(a: Column, b: Column, order: tuple[str, ...] = ("off", "warn", "fail")) -> Column:
    """The stricter of two gate modes."""
    return name_at(F.greatest(rank_of(a, order), rank_of(b, order)), order)


def readiness(total: Column, unowned: Column, errors: Column, unresolved: Column) -> Column:
    """100 less 40 for any error, 30 for any unresolved required edge, 20 by the unowned share, 10 if nothing is there; at least 0."""
    share = F.when(total > 0, F.round(F.lit(20.0) * unowned / total)).otherwise(0.0)
    score = 100 - F.when(errors > 0, 40).otherwise(0) - F.when(unresolved > 0, 30).otherwise(0) - share - F.when(total == 0, 10).otherwise(0)
    return F.greatest(F.lit(0.0), score).cast("int")


def readiness_level(score: Column, failing: Column) -> Column:
    return F.when(failing | (score < 70), "not_ready").when(score >= 90, "ready").otherwise("needs_attention")


def count_delta(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows by key on both sides and their difference, where it is not 0."""
    both = left.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    out = both.groupBy(key).agg(F.sum("a").alias("n_from"), F.sum("b").alias("n_to")).withColumn("delta", F.col("n_to") - F.col("n_from"))
    return out.where("delta <> 0")
