"""Canonical JSON and its digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_string(value: Column) -> Column:
    """A JSON string literal, or null."""
    escaped = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """A row as JSON: keys in order of their names, strings quoted, whole numbers and booleans plain."""
    parts: list[Column] = []
    for c in sorted(columns):
        kind = dict(df.dtypes)[c]
        value = json_string(F.col(c)) if kind == "string" else F.coalesce(F.col(c).cast("string"), F.lit("null"))
        parts.append(F.concat(F.lit(f'"{c}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(canonical_json(df, columns), 256)
