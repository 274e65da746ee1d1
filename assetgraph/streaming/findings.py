"""The line scan as a Structured Streaming job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_secret, normalize_space


def secret_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, snippet) of lines with a literal secret; the same for batches and streams."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "content"))
    return lines.where(has_secret(F.col("content"))).select("doc_id", (F.col("pos") + 1).alias("line"), normalize_space(F.col("content")).alias("snippet"))


def watch(spark: SparkSession, folder: str, schema, out: str, checkpoint: str):
    """Scan each new Parquet file of a folder once and append its findings; returns the running query."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return secret_lines(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
