"""Repository trees as a DataFrame of files, with the state of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import excluded

# File kinds that are never read as text.
OPAQUE = ("avif", "bmp", "eot", "gif", "ico", "jpeg", "jpg", "otf", "pdf", "png", "ttf", "webp", "woff", "woff2", "zip")


def is_text(content: Column, path: Column) -> Column:
    """No NUL byte, valid UTF-8, and no opaque extension."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (F.position(F.lit(b"\x00"), content) == 0) & F.is_valid_utf8(content.cast("string")) & ~extension.isin(*OPAQUE)


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, most_bytes: int = 512 * 1024, most_depth: int = 16) -> DataFrame:
    """(path, size_bytes, state, content_hash, classification, content) of every file below root.

    state is parsed, excluded, deep or oversize; only parsed files have a content.  The
    conditions that need no content come first, so the bytes of rejected files are not kept.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), "^" + base + "/", "")
    files = files.select(path.alias("path"), F.col("length").alias("size_bytes"), "content")
    depth = F.size(F.split("path", "/"))
    state = F.when(excluded(F.col("path"), exclude or []), "excluded").when(depth > most_depth, "deep").when(F.col("size_bytes") > most_bytes, "oversize").otherwise("parsed")
    out = files.withColumn("state", state)
    parsed = F.col("state") == "parsed"
    kind = F.when(parsed, F.when(is_text(F.col("content"), F.col("path")), "text").otherwise("binary"))
    return out.select("path", "size_bytes", "state", F.when(parsed, F.sha2("content", 256)).alias("content_hash"), kind.alias("classification"), F.when(kind == "text", F.col("content").cast("string")).alias("content"))


def reference_fixpoint(seed: DataFrame, tree: DataFrame, most_rounds: int = 64) -> DataFrame:
    """seed(path), tree(path, refs): paths reached by following refs until nothing new comes, with the round."""
    from ..operators.graph import reachability

    edges = tree.select(F.col("path").alias("src"), F.explode("refs").alias("dst"))
    rows = reachability(edges, seed.select(F.col("path").alias("source")), most_rounds)
    return rows.groupBy(F.col("node").alias("path")).agg(F.min("depth").alias("depth"))
