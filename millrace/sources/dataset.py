"""Scan of Parquet files in their row order."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..table import HIDDEN, OrderKey, Table, col


def scan(spark: SparkSession, *paths: str, batch: str | None = None) -> Table:
    """Read Parquet files as a table ordered by file and row.

    Part numbers are compared as numbers, so more than 99,999 parts stay in order.
    `batch` names a partition column that orders the files first and is hidden.
    """
    return in_file_order(spark.read.parquet(*paths), batch)


def in_file_order(df: DataFrame, batch: str | None = None) -> Table:
    path = F.col("_metadata.file_path")
    part = F.regexp_extract(path, r"/part-([0-9]+)[^/]*$", 1).try_cast("int")
    keys = [part, path, F.col("_metadata.row_index")]
    if batch is not None:
        keys.insert(0, col(batch))
    visible = [col(c) for c in df.columns if c != batch]
    hidden = [k.alias(f"{HIDDEN}{i}") for i, k in enumerate(keys)]
    order = tuple(OrderKey(f"{HIDDEN}{i}") for i in range(len(keys)))
    return Table(df.select(*visible, *hidden), order)


def stored(table: Table, name: str) -> Table:
    """The table read back from the shared folder, so that its plan runs only once.

    Later steps may then read it several times, see its exact size, and do not
    depend on how often its tasks ran.
    """
    spark = table.df.sparkSession
    path = scratch_path(spark, name)
    table.df.write.parquet(path)
    return replace(table, df=spark.read.parquet(path))
