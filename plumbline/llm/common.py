"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a task's memory does not follow the length of documents.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python operators get, by rows and, where Spark can, by bytes. Spark reads these
    settings when a query runs, not when it is built, so all operators set the same bounds and leave them set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo divisor."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(divisor)


def bounded_sample(rows: DataFrame, size: int, *key: str) -> DataFrame:
    """All rows if they are at most `size`, else about `size` of them by the hash of their key. Each task filters its own
    rows, so that nothing is sorted or gathered to choose them."""
    n, parts = rows.count(), 1 << 30
    return rows if n <= size else rows.filter(F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(parts)) < size * parts // n)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share. Only a local master, where both
    are one process, may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.shared_at = path
    return found


def discard(*found: DataFrame) -> None:
    """Delete the files of materialized rows that nothing reads any more: what came of them is itself materialized."""
    for df in found:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_STATE: dict[object, object] = {}


def worker_state(key: object, make: Callable[[], object]):
    """What an operator keeps in a Python worker from batch to batch. Workers outlive operators, so that a new one's state
    replaces the last one's and a worker never holds the caches of several."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def free_state() -> None:
    """For operators that keep nothing: frees what the last one left in this worker."""
    _STATE.clear()


def texts(batch, column: str) -> list[str]:
    """The batch's strings; null counts as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]
