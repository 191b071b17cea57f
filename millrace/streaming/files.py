"""Incremental file input: Structured Streaming keeps track of the files read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sinks.datasets import aligned, write_batch
from ..table import Table


def run_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    location: str,
    state: str,
    transform: Callable[[Table], Table] = lambda table: table,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process the Parquet files that arrived since the last run and stop.

    Every micro-batch is written under its own number, so a batch repeated after a
    failure replaces itself.  `state` is the checkpoint folder of the query.
    """
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    wanted = transform(Table(spark.createDataFrame([], schema))).schema

    def deliver(batch: DataFrame, number: int) -> None:
        write_batch(aligned(transform(Table(batch)).frame(), wanted), location, number)

    query = (
        stream.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
