"""Bounded shell grammar: one text into words and operators, with spans.

The text is covered by pieces of one pattern: blanks (with the comment that they begin), operators, words made of plain
runs, quoted parts and escapes, and a rest that no word can begin with: an open quote or an escape
at the end.  A text with such a rest is unsupported; it keeps the tokens before the one that could not be read.  The pattern's
loops never give back what they took, so a very long word needs no stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let, running_sums, units
from .text import _BLANK

OPERATOR = r"&&|\|\||>>|<<|&>|[|&;<>]"
_SEGMENT = r"""'[^']*+'|"(?:[^"\\]++|\\[\s\S])*+"|\\[\s\S]"""
_WORD = rf"""(?:[^{_BLANK}|&;<>'"\\]++|{_SEGMENT})++"""
_PIECE = rf"^#[\s\S]*+|[{_BLANK}]++(?:#[\s\S]*+)?|{OPERATOR}|{_WORD}|[\s\S]++"
_READABLE = rf"^(?:#[\s\S]*+|(?:[{_BLANK}]++(?:#[\s\S]*+)?|{OPERATOR}|{_WORD})*+)\z"  # all pieces but the rest
_IN_WORD = rf"""[^'"\\]++|{_SEGMENT}"""
TOKEN_TYPE = "array<struct<kind:string,value:string,raw:string,start:int,end:int,quoted:boolean,substitution:boolean>>"


def _segment_value(s: Column) -> Column:
    inner = F.substring(s, 2, F.length(s) - 2)
    return (
        F.when(s.startswith("'"), inner)
        .when(s.startswith('"'), F.regexp_replace(inner, r"\\([\s\S])", "$1"))
        .when(s.startswith("\\"), F.substring(s, 2, 2))
        .otherwise(s)
    )


def _substitutes(s: Column) -> Column:
    """A command substitution that is not quoted by ' or an escape."""
    plain = F.when(s.startswith("'") | s.startswith("\\"), F.lit("")).otherwise(F.regexp_replace(s, r"\\[\s\S]", "\u0001"))
    return plain.contains("`") | plain.contains("$(")


def _token(raw: Column, end: Column) -> Column:
    def made(operator: Column, parts: Column) -> Column:
        return F.struct(
            F.when(operator, "operator").otherwise("word").alias("kind"),
            F.when(operator, raw).otherwise(F.array_join(F.transform(parts, _segment_value), "")).alias("value"),
            raw.alias("raw"),
            (end - units(raw)).alias("start"),
            end.alias("end"),
            F.when(operator, False).otherwise(F.exists(parts, lambda s: s.startswith("'") | s.startswith('"'))).alias("quoted"),
            F.when(operator, False).otherwise(F.exists(parts, _substitutes)).alias("substitution"),
        )

    return let(raw.rlike(rf"^(?:{OPERATOR})\z"), F.regexp_extract_all(raw, F.lit(_IN_WORD), 0), made)


def _is_blank(piece: Column, first: Column) -> Column:
    return piece.rlike(rf"^[{_BLANK}]") | (first & piece.startswith("#"))


def shell_tokens(text: Column) -> Column:
    """struct<tokens, supported>; a null text has no tokens."""
    n = F.size

    def open_end(pieces: Column) -> Column:
        last = F.try_element_at(pieces, F.lit(-1))
        return F.coalesce((n(pieces) > 0) & last.rlike(r"""^['"\\]""") & ~last.rlike(rf"^(?:{_WORD})\z"), F.lit(False))

    def read(pieces: Column, is_open: Column) -> Column:
        before = F.try_element_at(pieces, F.lit(-2))
        joined = F.coalesce((n(pieces) > 1) & ~_is_blank(before, n(pieces) == 2) & ~before.rlike(rf"^(?:{OPERATOR})\z"), F.lit(False))
        return F.slice(pieces, F.lit(1), n(pieces) - F.when(is_open & joined, 2).when(is_open, 1).otherwise(0))

    def result(pieces: Column, is_open: Column, read: Column) -> Column:
        ends = running_sums(F.transform(read, units))
        placed = F.zip_with(read, ends, lambda p, e: F.struct(p.alias("raw"), e.alias("end")))
        real = F.filter(placed, lambda p: ~_is_blank(p["raw"], p["end"] == units(p["raw"])))
        return F.struct(F.transform(real, lambda p: _token(p["raw"], p["end"])).alias("tokens"), (~is_open).alias("supported"))

    none = F.struct(F.array().cast(TOKEN_TYPE).alias("tokens"), F.lit(True).alias("supported"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, let(F.regexp_extract_all(text, F.lit(_PIECE), 0), open_end, read, result)).otherwise(none)


def shell_supported(text: Column) -> Column:
    """Whether shell_tokens can read a text to its end, without its tokens; most texts have nothing that could stay open."""
    return F.coalesce(~text.rlike(r"""['"\\]""") | text.rlike(_READABLE), F.lit(True))
