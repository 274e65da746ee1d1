"""A view of Markdown for checks of prose: code, comments and link targets are blanked, and every other character keeps its place.

Masked characters become spaces and line ends stay, so a place in the view is the same place in the source, in UTF-16 units and in
lines.  What begins first wins, as in `a <!-- ` b --> `c``: fenced blocks (to the closing fence of the same mark, or the end), comments (to `-->`, or the end),
inline code (between runs of equally many backticks), targets of inline links and images, and addresses in angle brackets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .destinations import slice16
from .spans import let, match_spans, units

# what the view blanks, in patterns whose loops need no stack; groups 1 and 2 are the marks of a fence, group 3 those of inline code
_FENCE = r"(?m:^) {0,3}(?:(`{3,})[^`\n]*+|(~{3,})[^\n]*+)(?:\n|\z)[\s\S]*?(?:(?<=\n) {0,3}(?:\1`*|\2~*)[ \t]*+(?m:$)|\z)"
_COMMENT = r"<!--[\s\S]*?(?:-->|\z)"
_CODE = r"(?<!`)(`+)(?!`)(?:[^`\n]++|\n(?![ \t]*\n)|(?!\3(?!`))`++)*+\3(?!`)"
_LINK = r"(?<=\])\((?:[^()\n\\]|\\.|\([^()\n]*\))*+\)"
_ADDRESS = r"<(?:https?|mailto):[^<>\s]*+>"


PATTERN = "|".join((_FENCE, _COMMENT, _CODE, _LINK, _ADDRESS))


def _kind(t: Column) -> Column:
    return (
        F.when(t.rlike(r"^ {0,3}(?:`{3,}|~{3,})[^\n]*(?:\n|\z)") & ~t.rlike(r"^(`+)[^`\n][^\n]*\1\z"), "fence")
        .when(t.startswith("<!--"), "comment")
        .when(t.startswith("`"), "code")
        .when(t.startswith("("), "link")
        .otherwise("address")
    )


def masked_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of what the view blanks, in order."""
    return F.transform(match_spans(text, PATTERN), lambda s: F.struct(_kind(s["text"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))


def masked_view(text: Column) -> Column:
    """struct<view, spans>; a null text has none."""

    def view(spans: Column) -> Column:
        blank = lambda s: F.regexp_replace(F.regexp_replace(s["text"], r"[\x{10000}-\x{10FFFF}]", "  "), r"[^\r\n]", " ")
        pieces = F.transform(spans, lambda s, i: F.concat(slice16(text, F.when(i > 0, F.get(spans, F.greatest(i - 1, F.lit(0)))["end"]).otherwise(0), s["start"]), blank(s)))
        tail = slice16(text, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)), units(text))
        shown = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
        return F.struct(shown.alias("view"), F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))

    return F.when(text.isNotNull(), let(masked_spans(text), view))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a UTF-16 offset."""
    return F.regexp_count(slice16(text, F.lit(0), offset), F.lit("\r\n|\n|\r")) + 1
