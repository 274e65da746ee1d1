"""Repeated sections, headings and code blocks: thresholds, boundaries and the cap."""

from __future__ import annotations

from assetgraph.operators import repeats

LONG = " ".join(f"word{i} of the text" for i in range(20))
CODE = "make all --verbose --output build/reports/summary.json --retries 3 --timeout 60 --jobs 8"


def parts(spark, docs):
    df = spark.createDataFrame([(p, t, 1) for p, t in docs], "p string, t string, key int")
    return repeats.document_parts(df, "p", "t")


def test_parts(spark):
    docs = [
        ("a", f"# Shared section of the handbook\r\n{LONG}\r\n\r\n## Part one of it all ##\r\nx\r\n# Usage\r\n{LONG} end"),
        ("b", f"intro\n\n#  Shared   section of the handbook\n{LONG}\n## Part one of it all\nx\n# Other"),
        ("c", f"```sh\n# Shared section of the handbook\n{CODE}\n```\n~~~~\n{CODE}\n```\n~~~~\n# SHARED SECTION OF THE HANDBOOK"),
        ("d", f"```sh\n#  Shared section of the handbook\n  {CODE}\n```"),
        ("e", "# short\n# Overview\nno"),
        ("f", None),
        ("g", ""),
    ]
    rows = parts(spark, docs).collect()
    got = {(r.kind, r.path, r.start_line, r.end_line) for r in rows}
    assert got == {
        ("section_hash", "a", 1, 5), ("section_hash", "a", 6, 7), ("section_hash", "b", 3, 6), ("heading", "a", 1, 1), ("heading", "b", 3, 3), ("heading", "c", 9, 9),
        ("code_block", "c", 1, 4), ("code_block", "c", 5, 8), ("code_block", "d", 1, 4),
    }
    groups = {(r.kind, r.n_docs, r.n, r.path, r.start_line) for r in repeats.repeated_parts(parts(spark, docs)).collect()}
    # the sections differ in the marks behind one heading; the headings and one code block are the same
    assert groups == {("heading", 3, 3, "a", 1), ("code_block", 2, 2, "c", 1)}
    assert repeats.repeated_parts(parts(spark, docs[-2:])).count() == 0


def test_sections_and_cap(spark):
    docs = [(f"{i}", f"# Heading number {i % 15} of the whole set\n{LONG} {i % 15}") for i in range(60)]
    groups = repeats.repeated_parts(parts(spark, docs))
    assert {(r.kind, r["count"]) for r in groups.groupBy("kind").count().collect()} == {("heading", 15), ("section_hash", 15)}
    report = repeats.capped(groups).collect()
    heads = [r.label for r in sorted((r for r in report if r.kind == "heading"), key=lambda r: r["rank"])]
    assert len(report) == 20 and heads == sorted(f"Heading number {i} of the whole set" for i in range(15))[:10]
