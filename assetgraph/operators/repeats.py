"""Sections, headings and fenced code that come back in several documents, and the report of the largest groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let, match_spans
from ..functions.text import estimate_tokens, normalize_space, text_hash, utf16_key, utf16_length
from .duplicates import outside_fences
from .windows import next_boundary

# Headings that say nothing, and the least sizes (characters, tokens, documents) of each kind.
GENERIC_HEADINGS = ("overview", "usage", "examples", "example", "setup", "installation", "configuration", "config", "troubleshooting", "notes", "references", "requirements", "prerequisites", "next steps", "background", "appendix")
LEAST = {"section_hash": (240, 40, 2), "heading": (24, 3, 3), "code_block": (80, 10, 2)}
CAP = 10  # groups of a kind in the report

_HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+|$)"
_BLOCK = r"(?m:^) {0,3}(?:(`{3,})[^`\n]*+|(~{3,})[^\n]*+)(?:\n|\z)[\s\S]*?(?:(?<=\n) {0,3}(?:\1`*|\2~*)[ \t]*+(?m:$)|\z)"


def normal_heading(title: Column) -> Column:
    """Blanks joined, without the marks around it, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(normalize_space(title), r"^#+\s*", ""), r"\s+#+\z", ""))


def _large_enough(kind: str, normal: Column) -> Column:
    chars, tokens, _ = LEAST[kind]
    return (utf16_length(normal) >= chars) & (estimate_tokens(normal) >= tokens)


def document_parts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(kind, key, label, path, start_line, end_line) of the sections, headings and code blocks of each document that are large enough.

    A section runs to the line before the next heading of no greater depth, so a line belongs to six sections at most.
    """
    content = F.regexp_replace(F.col(text), "\r\n|\r", "\n")
    rows = docs.select(F.col(doc).cast("string").alias("path"), content.alias("t")).where("t is not null").withColumn("lines", F.split("t", "\n"))
    heads = F.transform(
        F.filter(outside_fences(F.col("lines")), lambda x: x["content"].rlike(_HEADING)),
        lambda x: F.struct(x["line"].alias("ord"), F.length(F.regexp_extract(x["content"], _HEADING, 1)).alias("depth")),
    )
    placed = rows.where(F.col("t").rlike("(?m)^ {0,3}#")).withColumn("heads", heads).select("path", "lines", F.explode(next_boundary(F.col("heads"))).alias("h"))
    start, end = F.col("h.ord"), F.coalesce(F.col("h.next_ord") - 1, F.size("lines"))
    placed = placed.select("path", start.alias("start_line"), end.cast("int").alias("end_line"), F.element_at("lines", start).alias("title"), F.array_join(F.slice("lines", start, end - start + 1), "\n").alias("body"))
    section = normalize_space(F.col("body"))
    sections = placed.withColumn("normal", section).where(_large_enough("section_hash", F.col("normal")))
    sections = sections.select(F.lit("section_hash").alias("kind"), text_hash(F.col("normal")).alias("key"), "path", "start_line", "end_line").withColumn("label", F.concat(F.lit("section hash "), F.substring("key", 1, 12)))
    headings = placed.withColumn("key", normal_heading(F.regexp_replace("title", _HEADING, ""))).where(_large_enough("heading", F.col("key")) & ~F.col("key").isin(*GENERIC_HEADINGS))
    shown = F.trim(F.regexp_replace("title", _HEADING + r"|[ \t]+#+[ \t]*$", ""))
    headings = headings.select(F.lit("heading").alias("kind"), "key", "path", "start_line", F.col("start_line").alias("end_line"), shown.alias("label"))

    def block(s: Column) -> Column:
        lines = F.split(s["text"], "\n")
        closed = (F.size(lines) > 1) & F.element_at(lines, -1).rlike(r"^ {0,3}(?:`{3,}|~{3,})[ \t]*$")
        inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - F.when(closed, 2).otherwise(1), F.lit(0)))
        language = F.regexp_extract(F.element_at(lines, 1), r"^ {0,3}(?:`{3,}|~{3,})[ \t]*([^\s`]*)", 1)
        return F.struct(F.when(language == "", "plain").otherwise(language).alias("language"), normalize_space(F.array_join(inner, "\n")).alias("normal"), s["start"].alias("start"), F.size(lines).alias("n"))

    spans = let(match_spans(F.col("t"), _BLOCK), lambda found: F.transform(found, block))
    code = rows.where(F.col("t").rlike("(?m)^ {0,3}(?:```|~~~)")).select("path", "t", F.explode(spans).alias("b")).where(_large_enough("code_block", F.col("b.normal")))
    line = F.regexp_count(F.decode(F.substring(F.encode("t", "UTF-16BE"), F.lit(1), 2 * F.col("b.start")), "UTF-16BE"), F.lit("\n")) + 1
    code = code.select(F.lit("code_block").alias("kind"), text_hash(F.concat(F.col("b.language"), F.lit("\n"), F.col("b.normal"))).alias("key"), "path", line.alias("start_line"), (line + F.col("b.n") - 1).alias("end_line"), "b.language")
    code = code.select("kind", "key", "path", "start_line", "end_line", F.concat("language", F.lit(" code block "), F.substring("key", 1, 12)).alias("label"))
    columns = ["kind", "key", "label", "path", "start_line", "end_line"]
    return sections.select(*columns).unionByName(headings.select(*columns)).unionByName(code.select(*columns))


def repeated_parts(parts: DataFrame) -> DataFrame:
    """(kind, key, label, n_docs, n, path, start_line): parts in enough documents, with the place that comes first by path and line."""
    first = F.min(F.struct(utf16_key(F.col("path")).alias("k"), "start_line", "path", "label")).alias("first")
    per_doc = parts.groupBy("kind", "key", "path").agg(F.count("*").alias("c"), F.min(F.struct("start_line", "label")).alias("s")).select("kind", "key", "path", "c", "s.start_line", "s.label")
    groups = per_doc.groupBy("kind", "key").agg(F.count("*").alias("n_docs"), F.sum("c").alias("n"), first)
    least = F.create_map(*(F.lit(x) for kind, (_, _, files) in LEAST.items() for x in (kind, files)))[F.col("kind")]
    return groups.where(F.col("n_docs") >= least).select("kind", "key", F.col("first.label").alias("label"), "n_docs", "n", F.col("first.path").alias("path"), F.col("first.start_line").alias("start_line"))


def capped(groups: DataFrame, most: int = CAP) -> DataFrame:
    """The report: of each kind the groups of most documents, then of most places, then by label and key."""
    order = Window.partitionBy("kind").orderBy(F.desc("n_docs"), F.desc("n"), utf16_key(F.col("label")), utf16_key(F.col("key")))
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
