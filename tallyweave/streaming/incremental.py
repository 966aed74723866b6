"""Incremental arrival: files are the change stream, a checkpoint its offset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changes(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Every file of the folder once, those that are there already first; files_per_batch limits a micro-batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def append_new(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of keys not met before to target, exactly once, and stops when all files are read.

    Keys stay in the state store, so a key that comes again after a restart is left out too.
    """
    return stream.dropDuplicates([key]).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_counts(stream: DataFrame, keys: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Running counts by keys; sink gets the changed groups of each micro-batch."""
    counts = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives each micro-batch to step with its number, by which a step that is run again can know its own output."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
