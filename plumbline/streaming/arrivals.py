"""Maps that arrive over time: the axis fits of each micro-batch's labels are appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.fitting import axis_fit

LABELS = "map_id long, axis string, seq int, pos double, value double"


def fit_arrivals(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Fits the labels of files that appear in `source`; a map's labels come in one file. Each batch writes its own
    folder, and a batch that is run again overwrites it, so that every fit is there once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        axis_fit(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream = spark.readStream.schema(LABELS).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
