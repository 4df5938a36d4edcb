"""Profiles of streams: each micro-batch adds mergeable partial statistics, which are merged when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.incremental import merge_partials, partials


def write_partials(stream: DataFrame, columns: list[str], path: str, checkpoint: str, once: bool = True, keys: tuple[str, ...] = ()) -> StreamingQuery:
    """Appends a Parquet folder of partial rows for every micro-batch; a repeated batch overwrites its own folder."""

    def add(batch: DataFrame, number: int) -> None:
        partials(batch, columns, *keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """column_name, rows, non_null, mean, stddev, least, largest, approx_distinct over all batches so far."""
    merged = merge_partials(spark.read.parquet(path), *keys)
    dev = F.when(F.col("non_null") > 1, F.sqrt(F.col("m2") / (F.col("non_null") - 1)))
    return merged.select(*keys, "column_name", "rows", "non_null", "mean", dev.alias("stddev"), "least", "largest", F.hll_sketch_estimate("sketch").alias("approx_distinct"))


def windowed_counts(stream: DataFrame, time: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, nulls and means of a value by event-time windows, with a watermark for late rows."""
    by = F.window(time, length)
    return stream.withWatermark(time, late).groupBy(by).agg(F.count("*").alias("rows"), F.count_if(F.col(value).isNull()).alias("null_count"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "rows", "null_count", "mean")
