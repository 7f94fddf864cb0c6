"""What the text operators share: the cluster's shared folder, tables that cut lineage, safe input columns."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_FALLBACK = "/tmp/checkpoints/lathwork"
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where a session of one machine has none (tests), a local one is set;
    on a cluster, where a local folder is not shared, that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_FALLBACK
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes stored tables from which nothing will be read any more."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t.stored_at
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """The driver lets go of what finished rounds have left: classes made for their plans, their broadcasts and shuffles.

    Operators that go round after round call it between rounds, so that a driver's memory does not grow with their number.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python a few MB at a time, whatever their length, unless the session asks for still fewer rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) in (0, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), with a null text as the empty one; other columns, whatever their names, stay out of the way."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes, key and check, by which a text is found again; together 128 bits."""
    return F.xxhash64(text).alias("key"), F.xxhash64(F.lit("check"), text).alias("check")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most ``rows`` rows; asked before it is broadcast."""
    return df.limit(rows + 1).count() <= rows


#: what modules keep in a Python worker from task to task, and how each is dropped
KEPT: dict[str, Callable[[], object]] = {}


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few rows at a time become Python objects.

    Workers outlive operators; a task first drops what other operators have kept in its worker.
    """
    for name, drop in KEPT.items():
        if name != keep:
            drop()
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def give_back() -> None:
    """Freed memory goes back to the machine: Arrow's pool and, with glibc, the C heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
