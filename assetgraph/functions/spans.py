"""Places in texts: matches with their offsets, as column expressions.  Offsets count UTF-16 units from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128  # numbers that are summed one by one


def let(*bound: Column | Callable) -> Column:
    """let(value, ..., use): use(value, ...) with each value made once, however often it is used; a value can itself be a function of those before it."""
    *values, use = bound

    def bind(i: int, known: tuple[Column, ...]) -> Column:
        if i == len(values):
            return use(*known)
        value = values[i](*known) if callable(values[i]) and not isinstance(values[i], Column) else values[i]
        return F.get(F.transform(F.array(value), lambda v: bind(i + 1, (*known, v))), F.lit(0))

    return bind(0, ())


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def _running(numbers: Column, start: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """Folds of an array's first 1, 2, ... integers, in blocks: near linear in its length."""
    whole = lambda xs: F.aggregate(xs, start, fold)

    def blocks(numbers: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")), lambda b: F.slice(numbers, b * _BLOCK + 1, _BLOCK))

    def within(numbers: Column, blocks: Column, totals: Column) -> Column:
        before = F.transform(blocks, lambda _, i: whole(F.slice(totals, F.lit(1), i)))
        return F.zip_with(blocks, before, lambda block, s: F.transform(block, lambda _, i: fold(s, whole(F.slice(block, F.lit(1), i + 1)))))

    some = let(numbers, blocks, lambda _, b: F.transform(b, whole), within)
    return F.when(F.size(numbers) > 0, F.flatten(some)).otherwise(F.array().cast("array<int>"))


def running_sums(numbers: Column) -> Column:
    return _running(numbers, F.lit(0), lambda a, x: a + x)


def running_max(numbers: Column) -> Column:
    """Of numbers of 0 or more."""
    return _running(numbers, F.lit(0), lambda a, x: F.greatest(a, x))


def match_spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<text, start, end>>: all matches of a pattern that matches no empty text.

    What lies between the matches comes from a split, so a text costs its matches and not its characters.
    keep: a condition on a match's text; matches that fail it are left out.
    """

    def spans(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        ends = running_sums(F.zip_with(gaps, matches, lambda g, m: units(g) + units(m)))
        placed = F.zip_with(matches, ends, lambda m, e: F.struct(m.alias("text"), (e - units(m)).alias("start"), e.alias("end")))
        return placed if keep is None else F.filter(placed, lambda s: keep(s["text"]))

    found = let(F.regexp_extract_all(text, F.lit(pattern), 0), spans)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<text:string,start:int,end:int>>"))


def group_spans(spans: Column, pattern: str, group: int) -> Column:
    """Spans of a group of each match's pattern: where its text first stands in the match."""

    def of(s: Column) -> Column:
        start = lambda raw: s["start"] + units(F.substring(s["text"], F.lit(1), F.position(raw, s["text"]) - 1))
        return let(F.regexp_extract(s["text"], pattern, group), start, lambda raw, at: F.struct(raw.alias("text"), at.alias("start"), (at + units(raw)).alias("end")))

    return F.transform(spans, of)
