"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, mixing.

Each stage is written as Parquet and read again before the next.  All but the last return
the columns of documents.

language_id     documents without a language (no letters, no text) go
near_dups       of each group of near duplicates one row stays, of smallest id (null last)
decontaminate   documents contaminated by benchmark passages go
secret_scan     secrets are replaced by their kind in the text; every document stays
mix             source mixing: every document with the words to take from it by the training schedule, range-sorted by its position

SQL cannot express the first stage's model, so ORACLE_SQL is None and the stages are tested
against brute force.  Every stage takes the columns it needs by name, keeps others as
they are, whatever their names, and gives an empty table for an empty one.  The last adds size, source_size, target, taken and position;
a document's column of such a name is called document_<name> there.  Stages decide for each row, so ids can
repeat or be null.  Stages can be chained without writing what lies between: a stage leaves the tables that its result is read from,
and `run` deletes them once the result is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetgraph.llm.common import clear_scratch, fold, read_table, scratch_path, scratch_scope, written, written_by
from assetgraph.llm.decontaminate import find_contamination
from assetgraph.llm.jaccard_join import jaccard_components
from assetgraph.llm.language_id import identify_language
from assetgraph.llm.mixing import scheduled_mix
from assetgraph.llm.secret_scan import scan_secrets

ORACLE_SQL = None


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[..., DataFrame]]:
    """docs under names that clash with no result, the new name of each column, and a function that selects the columns under their old names."""
    new = {c: f"document_column_{i}" for i, c in enumerate(docs.columns)}

    def back(df: DataFrame, **changed) -> DataFrame:
        return df.select(*(changed.get(c, F.col(n)).alias(c) for c, n in new.items()))

    return docs.toDF(*new.values()), new, back


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents in which no language is found."""
    rows, name, back = apart(docs)
    held_out = F.coalesce(fold(name["doc_id"], 4) == 2, F.lit(False))
    found = identify_language(rows, ~held_out, name["doc_id"], name["text"], name["lang"], keep=rows.columns)
    return back(found.where("lang_pred <> 'und'"))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component, of smallest id (null last)."""
    # ids can repeat or be null, so rows are told apart by a number; written, since it must not change, and in buckets, so that no join shuffles the texts again
    named, name, back = apart(docs)
    row, doc_id = f"row_{uuid.uuid4().hex}", name["doc_id"]
    rows = written_by(named.withColumn(row, F.monotonically_increasing_id()), "near_dups", row, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch_path(spark, "near-dups-kept")
    with scratch_scope() as made:
        found = jaccard_components(rows, id_col=row, text_col=name["text"], row_col=row).select(F.col("doc_id").alias(row), "component_id")
        least = found.join(rows.select(row, doc_id), row).groupBy("component_id").agg(F.min(F.struct(F.col(doc_id).isNull(), doc_id, row)).alias("least"))
        kept = written(least.select(f"least.{row}"), "near-dups-kept", path)
    clear_scratch(spark, made)
    return back(rows.join(kept, row, "left_semi"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents."""
    rows, name, back = apart(docs)
    found = find_contamination(rows, read_table(spark, sf_dir, "benchmark"), name["doc_id"], name["text"], keep=rows.columns)
    return back(found.where("not contaminated"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars follows the text."""
    rows, name, back = apart(docs)
    clean = scan_secrets(rows, name["doc_id"], name["text"], keep=rows.columns)
    changed = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("spans") == "", F.col(name["n_chars"])).otherwise(F.length("redacted")).cast(docs.schema["n_chars"].dataType)
    return back(clean, **changed)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, with the words to take from each and the position of its first copy."""
    rows, name, _ = apart(docs)
    out = scheduled_mix(rows, keep=rows.columns, id_col=name["doc_id"], text_col=name["text"], source_col=name["source"])
    results = [c for c in out.columns if c not in rows.columns]
    return out.select(*(F.col(n).alias(f"document_{c}" if c.lower() in results else c) for c, n in name.items()), *results)


STAGES = [
    ("language_id", language_id),
    ("near_dups", near_dups),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared scratch folder."""
    docs = read_table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, make in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope() as made:
            make(spark, docs, sf_dir).write.parquet(path)
        clear_scratch(spark, [*made, *before])  # what the stage wrote on the way, and the documents of the one before
        before, docs = [path], spark.read.parquet(path)
    return docs
