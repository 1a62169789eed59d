"""Stage boundaries of long plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stage(df: DataFrame) -> DataFrame:
    """The rows as files in the shared folder that spark.checkpoint.dir names: computed once, and lost executors cost no
    more than the stage that follows."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
