"""Answers of a costly service, kept by what was asked: one row a key whatever is retried.

The store is a folder of Parquet files that is only added to. A write adds the keys that are not there yet, as one commit;
if two jobs answer a key at once, both rows are there and the lookup takes one of them. Each row carries a checksum of its answer, and a row that
does not fit it, or a file that cannot be read, counts as a miss and is answered again.

Cases: a null key is never stored and always a miss; an empty store, or none, gives misses only; repeated keys ask once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORED = "key string, answer string, checksum long"


def key_of(service: Column, payload: Column) -> Column:
    """A name for what was asked: the service and a hash of the bytes sent."""
    return F.sha2(F.concat(service.cast("binary"), F.lit("|").cast("binary"), payload.cast("binary")), 256)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(key, answer) of the sound rows, one a key."""
    try:
        found = spark.read.schema(STORED).option("ignoreCorruptFiles", True).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], STORED)
    return found.filter(F.xxhash64("key", "answer") == F.col("checksum")).groupBy("key").agg(F.min("answer").alias("answer"))


def lookup(asked: DataFrame, folder: str) -> DataFrame:
    """asked(key, ...) with the answer, null for a miss."""
    return asked.join(stored(asked.sparkSession, folder), "key", "left")


def store(answers: DataFrame, folder: str) -> None:
    """Adds answers(key, answer) whose keys have no sound row yet."""
    fresh = answers.filter("key is not null and answer is not null").groupBy("key").agg(F.min("answer").alias("answer"))
    fresh = fresh.join(stored(answers.sparkSession, folder).select("key"), "key", "left_anti")
    fresh.withColumn("checksum", F.xxhash64("key", "answer")).write.mode("append").parquet(folder)


def answered(asked: DataFrame, folder: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """asked(key, ...) with answers: those that the store lacks come from `ask`, a function from the rows of distinct missing
    keys to (key, answer), and are stored first, so that a retry finds them."""
    missing = lookup(asked, folder).filter("answer is null and key is not null").drop("answer").dropDuplicates(["key"])
    store(ask(missing), folder)
    return lookup(asked, folder)
