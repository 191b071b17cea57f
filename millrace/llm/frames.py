"""Session settings and row identities the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch_path
from ..table import col

ARROW_ROWS = "1000"


def ready(spark: SparkSession) -> SparkSession:
    """Prepare the session; few rows an Arrow batch, since texts may be long."""
    prepare(spark)
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS,
        "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
        "spark.sql.parquet.compression.codec": "zstd",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows through a table in the shared folder: lineage ends, its size is known."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str) -> Column:
    """A text column as it is used: null is empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names an operator works with.

    Extra columns cannot clash with the operator's own since they are left out.
    """
    return df.select(*[col(source).alias(target) for target, source in columns.items()])


def row_name(id_column: str, text_column: str) -> Column:
    """What a row is known by: its id and a hash of its text; rows without id sort last."""
    return F.struct(
        col(id_column).isNull().alias("unnamed"),
        col(id_column).alias("id"),
        F.xxhash64(col(text_column)).alias("text_hash"),
    )


def with_row_name(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    """Add the name of each row under a column name that is free; also return that."""
    free = next(f"name{i}" for i in range(len(df.columns) + 1) if f"name{i}" not in df.columns)
    return df.withColumn(free, row_name(id_column, text_column)), free


def with_row_keys(df: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """Replace the names of rows by 128 bits: a key for joins and another to compare beside it.

    Joined by the key alone, with the other as a range, rows are dealt once, and what is
    grouped by both afterwards is dealt already.
    """
    row, check = f"{name}_row", f"{name}_check"
    keyed = df.withColumn(row, F.xxhash64(name)).withColumn(check, F.xxhash64(F.lit(1), name))
    return keyed.drop(name), row, check


def same_row(row: str, check: str, other_row: str, other_check: str) -> Column:
    return (F.col(row) == F.col(other_row)) & F.col(check).between(F.col(other_check), F.col(other_check))
