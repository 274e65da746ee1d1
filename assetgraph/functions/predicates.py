"""Predicates over paths, lifecycle states, severities, dates and owners."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Orders of the enumerations.
SEVERITIES = ("low", "medium", "high", "critical")
ACTIVE = ("experimental", "stable")
INACTIVE = ("suspended", "deprecated", "archived")
STATUSES = ("pass", "warn", "fail")
PLACEHOLDER_BOUNDARY = r"(?i)^(?:todo|tbd|tba|unknown|n/?a|none|placeholder|to be defined)(?:[\s:-].*)?$"


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place in the order, from 0; null for others."""
    out = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out


def name_at(rank: Column, order: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, order)), rank + 1)


def severity_meets(value: Column, threshold: str) -> Column:
    return rank_of(value, SEVERITIES) >= SEVERITIES.index(threshold)


def is_usable(status: Column) -> Column:
    """No status counts as usable."""
    return F.coalesce(status.isin(*ACTIVE), F.lit(True)) | ~F.coalesce(status.isin(*ACTIVE, *INACTIVE), F.lit(True))


def is_inactive(status: Column) -> Column:
    return F.coalesce(status.isin(*INACTIVE), F.lit(False))


def has_owner(owner: Column) -> Column:
    return F.coalesce(F.length(F.trim(owner)) > 0, F.lit(False))


def is_placeholder(text: Column) -> Column:
    """A usage boundary that only stands for one; blanks at the ends do not count."""
    return F.coalesce(F.trim(text).rlike(PLACEHOLDER_BOUNDARY), F.lit(False))


def iso_date(text: Column) -> Column:
    """The calendar date of a yyyy-MM-dd string; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def day_duration(text: Column) -> Column:
    """n of an ISO duration PnD; null for anything else."""
    return F.regexp_extract(text, r"^P(\d+)D$", 1).try_cast("int")


def freshness(reviewed: Column, cycle_days: Column, expires: Column, today: Column) -> Column:
    """expired, overdue or fresh; a missing date decides nothing."""
    overdue = F.date_add(reviewed, cycle_days) < today
    return F.when(F.coalesce(expires < today, F.lit(False)), "expired").when(F.coalesce(overdue, F.lit(False)), "overdue").otherwise("fresh")


def excluded(path: Column, names: list[str]) -> Column:
    """A segment equals a name, or the path is a name, or lies below one."""
    out = F.lit(False)
    for x in names:
        out = out | F.array_contains(F.split(path, "/"), x) | (path == x) | path.startswith(x + "/")
    return out


def glob_regex(pattern: str) -> str:
    """Java regex of a path pattern: ** over segments, * within one; without a star the path itself or what lies below it."""
    pattern = pattern.strip("/")
    if "*" not in pattern:
        return f"^{re.escape(pattern)}(/.*)?$"
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"
