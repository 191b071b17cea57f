"""Registration of queries and the fixtures they share."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace import Table, prepare
from millrace.session import ship


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None):
    """Register `fn(load, spark)`, where `load(table)` reads one of the tables."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            ship(spark, os.path.dirname(os.path.abspath(__file__)))
            return fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"), spark)

        QUERIES[name] = Query(run, oracle)
        return fn

    return register


def ordered(df: DataFrame, *keys: str) -> Table:
    return Table.of(df, list(keys))
