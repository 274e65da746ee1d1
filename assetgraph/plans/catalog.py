"""A catalog of assets and typed edges from parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metadata lists that make edges, and the kind of each.
EDGE_FIELDS = {
    "requires_context": "requires",
    "optional_context": "optional",
    "conflicts_with": "conflicts",
    "supersedes": "supersedes",
    "superseded_by": "superseded_by",
    "applies_to": "applies_to",
    "continues_with": "continues_with",
}


def classify(path: Column) -> Column:
    """Kind of an asset by its path; the first rule that fits."""
    return (
        F.when(path.rlike(r"(^|/)skills/[^/]+/SKILL\.md$"), "skill")
        .when(path.rlike(r"(^|/)skills/[^/]+/(profiles|references|examples)/"), F.regexp_extract(path, r"/(profile|reference|example)s/", 1))
        .when(path.rlike(r"^lenses/"), "context_lens")
        .when(path.rlike(r"^contexts?/"), "context")
        .when(path.rlike(r"(^|/)AGENTS\.md$|^\.agents/"), "agent")
        .otherwise("unknown")
    )


def assets(parsed: DataFrame) -> DataFrame:
    """(path, id, kind, owner, status) of each document; without a declared id the path is the id."""
    one = lambda k: F.try_element_at(F.try_element_at("metadata", F.lit(k)), F.lit(1))
    return parsed.select("path", F.coalesce(one("id"), F.col("path")).alias("id"), classify(F.col("path")).alias("kind"), one("owner").alias("owner"), one("status").alias("status"))


def edges(parsed: DataFrame) -> DataFrame:
    """(src, dst, kind): one row for each reference in the metadata lists."""
    one = F.coalesce(F.try_element_at(F.try_element_at("metadata", F.lit("id")), F.lit(1)), F.col("path"))
    rows = parsed.select(one.alias("src"), F.explode("metadata").alias("field", "values"))
    kinds = F.create_map(*(F.lit(x) for pair in EDGE_FIELDS.items() for x in pair))
    return rows.where(F.col("field").isin(*EDGE_FIELDS)).select("src", F.explode("values").alias("dst"), kinds[F.col("field")].alias("kind"))
