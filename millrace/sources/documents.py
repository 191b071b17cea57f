"""JSON files as documents."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import option, relative_path, under_root
from ..errors import ConfigError, DataError
from ..functions.shapes import document_text, parse_document
from ..sinks import storage
from ..table import HIDDEN, Documents, OrderKey

LAYOUTS = ("file", "lines")


@dataclass(frozen=True)
class JsonSource:
    """Read JSON documents: one per file, or one per line with `layout="lines"`.

    Lines files are split among tasks.  Text that is not JSON fails the job; flatten
    checks every document anyway, so `check=False` spares the second look.  A file
    without any byte is no document, which Spark's readers would pass over.
    """

    source_path: str = option("text", key="sourcePath")
    layout: str = option("select", choices=LAYOUTS, default="file")
    check: bool = True

    def __post_init__(self) -> None:
        relative_path(self.source_path)
        if self.layout not in LAYOUTS:
            raise ConfigError("layout must be file or lines.")

    def __call__(self, spark: SparkSession, root: str) -> Documents:
        path = under_root(root, relative_path(self.source_path))
        if self.layout == "file" and storage.has_empty_file(spark, path):
            raise DataError("A document is not valid JSON.")
        try:
            if self.layout == "file":
                files = spark.read.format("binaryFile").load(path)
                text = files.withColumn("value", F.try_validate_utf8(F.col("content").cast("string")))
            else:
                text = spark.read.text(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error.getCondition()):
                raise DataError("The JSON source is not available.") from None
            raise
        keys = [F.col("_metadata.file_path")]
        if self.layout == "lines":
            keys += [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
        body = checked(F.col("value")) if self.check else F.col("value")
        hidden = [k.alias(f"{HIDDEN}{i}") for i, k in enumerate(keys)]
        order = tuple(OrderKey(f"{HIDDEN}{i}") for i in range(len(keys)))
        return Documents(text.select(body.alias("body"), *hidden), order)


def checked(body: Column) -> Column:
    """The text itself, or an error when it is not exactly one JSON value.

    The JVM parsers stop after the first value and miss what follows it, so this is
    a strict Arrow-batched check.
    """
    failure = F.raise_error(F.lit("A document is not valid JSON."))
    return F.when(_is_document(body), body).otherwise(failure.cast("string"))


def compact(body: Column) -> Column:
    """Each document on one line in its shortest spelling, or an error if it is not JSON."""
    return _shortest(body)


@F.pandas_udf(T.StringType())
def _shortest(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda body: document_text(parse_document(body if body is not None else "")))


@F.pandas_udf(T.BooleanType())
def _is_document(bodies: pd.Series) -> pd.Series:
    return bodies.map(_parses).astype(bool)


def _parses(body: str | None) -> bool:
    try:
        parse_document(body if body is not None else "")
    except DataError:
        return False
    return True
