"""From documents to findings, suppressions and a ranked posture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CATEGORIES, PRIVATE_KEY_LINE, SECRET_LINE, copies_environment, has_hidden, has_secret, is_remote_default
from ..operators.aggregates import posture, top_ids
from ..operators.joins import apply_suppressions

# Further line rules of this engine as (id, severity, pattern).
LINE_RULES = (
    ("email_address", "medium", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"),
    ("phone_number", "low", r"\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("access_key", "critical", r"AKIA[A-Z0-9]{12,}"),
    ("long_hex", "high", r"[0-9a-f]{32,}"),
    ("license_notice", "low", r"(?i)licensed under|released under"),
)
SUPPRESSIONS = [("phone_number", "src1*/**", None), ("email_address", "src2/**", "1998-01-01"), ("license_notice", "src3", "2999-01-01")]


def line_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, path, rule_id, severity, line): one row for each rule that a line breaks.

    All rules are tested in one pass over the lines; only lines with a finding leave it.
    """
    text = F.col("text")
    may = text.rlike(SECRET_LINE) | text.rlike(PRIVATE_KEY_LINE) | is_remote_default(text) | text.rlike(r"(?i)\benv\b")
    for _, _, p in LINE_RULES:
        may = may | text.rlike(p)
    for c in CATEGORIES:
        may = may | has_hidden(text, c)
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path")
    # only texts that can hold a finding are cut into lines
    lines = docs.where(may | text.rlike("tool-ignore")).select("doc_id", path, F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "content"))
    content = F.col("content")
    rules = [("private_key", "critical", content.rlike(PRIVATE_KEY_LINE)), ("literal_secret", "high", has_secret(content)), ("remote_default", "medium", is_remote_default(content)), ("env_copy", "medium", copies_environment(content))]
    rules += [(i, s, content.rlike(p)) for i, s, p in LINE_RULES]
    rules += [(f"hidden_{c}", s, has_hidden(content, c, F.col("pos") == 0)) for c, s in zip(CATEGORIES, ("high", "medium"))]
    tests = [F.when(test, F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, s, test in rules]
    found = lines.select("doc_id", "path", (F.col("pos") + 1).alias("line"), F.explode(F.array_compact(F.array(*tests))).alias("f"))
    return found.select("doc_id", "path", "f.rule_id", "f.severity", "line")


def posture_topk(docs: DataFrame, today: str, k: int = 10) -> DataFrame:
    """The rules with most findings that no suppression covers."""
    active = apply_suppressions(line_findings(docs), SUPPRESSIONS, today).where("suppressed_by is null")
    return top_ids(posture(active.withColumnRenamed("rule_id", "finding_id")), k)
