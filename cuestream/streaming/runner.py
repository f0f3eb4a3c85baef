"""Start streams over growing folders and drain what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuestream.plans.session import shared_dir


def stream_files(spark: SparkSession, path: str, like: DataFrame, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream with the schema of a batch read; ``max_files`` limits a micro-batch."""
    reader = spark.readStream.schema(like.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def work_dir(spark: SparkSession, name: str) -> str:
    """New folder under the shared one, for a sink and its progress log."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input in append mode into a parquet table and read that back."""
    spark = stream.sparkSession
    base = work_dir(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/progress")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def drain_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None]) -> None:
    """Process all available input through a batch writer."""
    base = work_dir(stream.sparkSession, name)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/progress")
    query.trigger(availableNow=True).start().awaitTermination()
