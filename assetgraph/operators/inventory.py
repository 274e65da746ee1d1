"""Inventories: state ladders, enrichment, coverage and rendered views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import IGNORABLE, code_points


def candidate_outcome(parsed: Column, other: Column, other_state: Column) -> Column:
    """One parsed candidate resolves, several are ambiguous; else the only other state, several of which are ambiguous, or missing."""
    return F.when(parsed > 1, "ambiguous").when(parsed == 1, "resolved").when(other > 1, "ambiguous").when(other == 1, other_state).otherwise("missing")


def enrich(base: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """base with the number of rows of each part by key, 0 where there is none; parts are counted before the join."""
    out = base
    for name, rows in parts.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def logical_lines(lines: DataFrame, doc: str, ends: str) -> DataFrame:
    """(doc, first_line, n_lines, text): lines that end in `ends` go on with the next."""
    order = Window.partitionBy(doc).orderBy("line")
    before = F.lag("content").over(order)
    starts = F.when(before.isNull() | ~before.endswith(ends), 1).otherwise(0)
    numbered = lines.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(order))
    parts = F.array_sort(F.collect_list(F.struct("line", "content")))
    grouped = numbered.groupBy(doc, "_g").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"), parts.alias("p"))
    return grouped.select(doc, "first_line", "n_lines", F.array_join(F.transform("p", lambda x: x["content"]), " ").alias("text"))


def line_slice(text: Column, first: int, last: int) -> Column:
    """Lines first to last, from 1, both included."""
    return F.array_join(F.slice(F.split(text, "\r\n|\n|\r"), first, last - first + 1), "\n")


def missing_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field): required fields that are null or blank."""
    gaps = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "", F.lit(f)) for f in fields)))
    return df.select(key, F.explode(gaps).alias("field"))


def mermaid_edges(edges: DataFrame) -> DataFrame:
    """(src, text): the edges of each source as lines of a flow chart, in order of targets."""
    line = F.concat(F.lit("  n"), F.col("src").cast("string"), F.when(F.col("required"), F.lit(" --> n")).otherwise(F.lit(" -.-> n")), F.col("dst").cast("string"))
    rows = edges.groupBy("src").agg(F.array_sort(F.collect_set(F.struct("dst", line.alias("line")))).alias("p"))
    return rows.select("src", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"))


def grouped_view(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(from, to, n): edges between the groups(node, group) of their ends; none within a group."""
    a, b = groups.select(F.col("node").alias("src"), F.col("group").alias("from")), groups.select(F.col("node").alias("dst"), F.col("group").alias("to"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.count("*").alias("n"))


def corrupted_identifiers(keys: DataFrame, registered: DataFrame) -> DataFrame:
    """keys(path, key, authority), registered(identifier, authority): (path, key, authority, identifier, removed) of keys that become a registered identifier once unseen characters are
    taken out, and are not the identifier itself.  A value gains nothing by it: such a key is only reported."""
    dirty = keys.where(F.col("key").rlike(IGNORABLE)).withColumn("identifier", F.regexp_replace("key", IGNORABLE, ""))
    removed = code_points(F.array_distinct(F.regexp_extract_all("key", F.lit(IGNORABLE), F.lit(0))))
    return dirty.join(registered, ["identifier", "authority"]).select("path", "key", "authority", "identifier", removed.alias("removed"))
