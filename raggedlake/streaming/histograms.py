"""Histograms of streams: each micro-batch's sparse counts are added to a table of counts (an extension)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from raggedlake.operators.histogram import Histogram


def accumulate(stream: DataFrame, h: Histogram, columns: Sequence[Column | str], path: str, checkpoint: str, weight: Column | str | None = None) -> StreamingQuery:
    """Write each batch's counts to path/batch=n; a batch that is run again replaces its own."""

    def add(batch: DataFrame, n: int) -> None:
        h.count(batch, columns, weight).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total(spark: SparkSession, h: Histogram, path: str) -> Histogram:
    """The histogram of all batches so far."""
    counts = spark.read.option("basePath", path).parquet(path)
    return Histogram(h.axes, counts.groupBy(*h.names).agg(F.sum("weight").alias("weight")))
