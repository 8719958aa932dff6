"""Streams from files: what is new since the last run, and bounded batches for training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def new_files(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """A stream of the files of a folder; its checkpoint remembers those done. `files` bounds a batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(folder)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Hands every waiting batch to `each` and ends; a later call goes on where this one stopped."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def append_new(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Appends every waiting row to a Parquet folder, each once."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
