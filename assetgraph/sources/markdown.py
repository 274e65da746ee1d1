"""Markdown documents: frontmatter, headings, fences and links as columns.

A subset of CommonMark: ATX headings, fenced code, inline links.  Everything is done by
column functions on each document's lines; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRONTMATTER = r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)"


def frontmatter(text: Column) -> Column:
    """The block between the first two --- lines, or null."""
    block = F.regexp_extract(text, FRONTMATTER, 1)
    return F.when(text.rlike(FRONTMATTER), block)


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONTMATTER, "")


def metadata_values(block: Column) -> Column:
    """map key -> list of values, of `key: value`, `key: [a, b]` and `key:` with `- item` lines below."""
    flat = F.regexp_replace(block, r"\r?\n[ \t]*-[ \t]+", "\u0001")
    lines = F.filter(F.split(flat, r"\r?\n"), lambda s: s.rlike(r"^[A-Za-z0-9_.-]+[ \t]*:"))

    def entry(s: Column) -> Column:
        key = F.regexp_extract(s, r"^([A-Za-z0-9_.-]+)", 1)
        value = F.regexp_replace(s, r"^[A-Za-z0-9_.-]+[ \t]*:[ \t]*", "")
        items = F.split(F.regexp_replace(F.regexp_replace(value, r"^\[(.*)\]$", "$1"), "^\u0001", ""), F.when(value.startswith("["), F.lit(r"[ \t]*,[ \t]*")).otherwise(F.lit("\u0001")))
        clean = F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))
        return F.struct(key.alias("key"), F.filter(clean, lambda x: x != "").alias("value"))

    entries = F.transform(lines, entry)
    # the last of equal keys wins
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def _with_fences(lines: Column) -> Column:
    """array of struct(line, text, fenced), lines from 1; a fence's own lines are fenced."""
    empty = F.array().cast("array<struct<line:int,text:string,fenced:boolean>>")
    state = F.struct(empty.alias("rows"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.regexp_extract(s, r"^ {0,3}(`{3,}|~{3,})", 1)
        closes = (acc["open"] != "") & mark.startswith(acc["open"]) & s.rlike(r"^ {0,3}(`{3,}|~{3,})[ \t]*$")
        opened = F.when(acc["open"] == "", mark).when(closes, F.lit("")).otherwise(acc["open"])
        inside = (acc["open"] != "") | (mark != "")
        row = F.struct((acc["n"] + 1).alias("line"), s.alias("text"), inside.alias("fenced"))
        return F.struct(F.concat(acc["rows"], F.array(row)).alias("rows"), opened.alias("open"), (acc["n"] + 1).alias("n"))

    return F.aggregate(lines, state, step, lambda acc: acc["rows"])


def parse(docs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, metadata, lines, headings(line, depth, title), links(line, label, target), fences)."""
    out = docs.select(key, metadata_values(frontmatter(F.col(text))).alias("metadata"), _with_fences(F.split(F.col(text), r"\r?\n")).alias("lines"))
    prose = F.filter("lines", lambda x: ~x["fenced"])
    heads = F.filter(prose, lambda x: x["text"].rlike(r"^ {0,3}#{1,6}([ \t]|$)"))
    headings = F.transform(heads, lambda x: F.struct(x["line"].alias("line"), F.length(F.regexp_extract(x["text"], r"^ {0,3}(#{1,6})", 1)).alias("depth"), F.trim(F.regexp_replace(x["text"], r"^ {0,3}#{1,6}[ \t]*|[ \t]+#+[ \t]*$", "")).alias("title")))
    pattern = r"\[([^\]\[]*)\]\(([^()\s]+)\)"
    found = lambda x: F.arrays_zip(F.regexp_extract_all(x["text"], F.lit(pattern), F.lit(1)).alias("label"), F.regexp_extract_all(x["text"], F.lit(pattern), F.lit(2)).alias("target"))
    links = F.flatten(F.transform(prose, lambda x: F.transform(found(x), lambda y: F.struct(x["line"].alias("line"), y["label"].alias("label"), y["target"].alias("target")))))
    fences = F.size(F.filter("lines", lambda x: x["fenced"] & x["text"].rlike(r"^ {0,3}(`{3,}|~{3,})[^`]*$")))
    return out.select(key, "metadata", "lines", headings.alias("headings"), links.alias("links"), fences.alias("fence_lines"))
