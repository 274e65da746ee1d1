"""Helpers shared by the operators: scratch tables on shared storage, folds, Arrow batches."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_OWN: dict[str, str | None] = {}  # folders made here, by their full path, and their catalogue table
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or of setCheckpointDir.

    Where neither is set, a local session gets a temporary folder of its own; on a cluster that is
    an error, since executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """A list that is given the folders made by this thread's work inside the block, and by none other."""
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield made
    finally:
        _SCOPES.reset(token)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared scratch folder."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _OWN[path] = None
    for made in _SCOPES.get():
        made.append(path)
    return path


_SETTINGS: dict[tuple[int, str], tuple[int, str | None]] = {}  # settings changed for writes: how many writes hold each, and its value before
_LOCK = threading.Lock()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what runs inside the block; the last of the blocks that hold a setting puts its value back, also where threads write at once."""
    own = id(spark._jsparkSession)
    with _LOCK:
        for name, value in values.items():
            held, before = _SETTINGS.get((own, name), (0, None))
            _SETTINGS[own, name] = held + 1, before if held else spark.conf.get(name, None)
            spark.conf.set(name, value)
    try:
        yield
    finally:
        with _LOCK:
            for name in values:
                held, before = _SETTINGS.pop((own, name))
                if held > 1:
                    _SETTINGS[own, name] = held - 1, before
                elif before is None:
                    spark.conf.unset(name)
                else:
                    spark.conf.set(name, before)


def written(df: DataFrame, name: str, path: str | None = None, batch_bytes: int | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared scratch folder (to path, if given) and read it back.

    Its shuffles are deleted as soon as it is written.  batch_bytes: about the most bytes of an Arrow batch that its Python workers are given.
    """
    path = path or scratch_path(df.sparkSession, name)
    values = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_bytes:
        values["spark.sql.execution.arrow.maxBytesPerBatch"] = str(batch_bytes)
    with settings(df.sparkSession, values):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like written, in `buckets` buckets by key, so that grouping by key and joins on it need no shuffle of these rows."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").option("compression", "zstd")
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        writer.option("path", path).saveAsTable(table)
    _OWN[path] = table
    return spark.table(table)


def scratch_paths() -> list[str]:
    """The folders written here so far."""
    return list(_OWN)


def clear_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders written here, and their tables; results that are read lazily from them end."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in [p for p in dict.fromkeys(paths) if p in _OWN]:
        if table := _OWN.pop(path):
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        at = hadoop.Path(path)
        at.getFileSystem(conf).delete(at, True)


def refuse_clash(keep: list[str] | None, results: Iterable[str]) -> None:
    """Columns to keep may not have the name of a result."""
    if clash := {c.lower() for c in keep or ()} & {c.lower() for c in results}:
        raise ValueError(f"columns to keep have names of results: {', '.join(sorted(clash))}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def arrow_rows(schema: T.StructType) -> Callable[[dict[str, object]], pa.RecordBatch]:
    """A function that makes record batches of the given Spark schema from columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def make(columns: dict[str, object]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for f in target], schema=target)

    return make


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl) if isinstance(ddl, str) else ddl


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], ddl: str, text: str = "text") -> DataFrame:
    """mapInArrow over slices of bounded text size."""
    from .wordhash import chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield step(part)

    return df.mapInArrow(run, ddl)
