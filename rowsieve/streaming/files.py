"""Drop folders as streams, and running a stream over what has arrived so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def folder_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    file_format: str = "parquet",
    pattern: str | None = None,
    max_files: int | None = None,
    **options: str,
) -> DataFrame:
    """A stream of the files in ``folder``; the schema is fixed up front."""
    reader = spark.readStream.schema(schema).format(file_format).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return folder_stream(spark, sf_dir, schema, pattern=f"{name}.parquet")


def append_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what has arrived to the Parquet folder ``path`` and stop; returns the folder."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def each_available(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
) -> None:
    """Hand every micro-batch of what has arrived to ``handle`` and stop.

    A batch may be handed over again after a failure: ``handle`` must overwrite by batch id.
    """
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
