"""File sinks: folders of part files that keep the row order of their table.

Each sink writes in parallel.  Parts are numbered in row order, and a table whose
order was changed by an operator is range-partitioned and sorted first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import check_value, option, whole_number
from ..errors import ConfigError
from ..functions.casts import as_text
from ..table import Table, col


ROWS_PER_ARRAY = 100_000


def file_name(value: str) -> str:
    bad = not isinstance(value, str) or not value.strip() or "/" in value or "\\" in value
    if bad or value in (".", ".."):
        raise ConfigError("fileName must be a plain file name.")
    return value


@dataclass(frozen=True)
class CsvSink:
    """Comma-separated text with a header; null is empty, an empty text is quoted."""

    file_name: str = option("text", key="fileName")
    keep_order: bool = True

    format = "csv"
    content_type = "text/csv"

    def __post_init__(self) -> None:
        file_name(self.file_name)

    def write(self, table: Table, path: str) -> None:
        df = table.ordered_frame() if self.keep_order else table.frame()
        times = (T.TimestampType, T.TimestampNTZType)
        columns = [
            as_text(col(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, times) else col(f.name)
            for f in df.schema
        ]
        df.select(*columns).write.mode("errorifexists").options(
            header=True, sep=",", lineSep="\n", quote='"', escape='"', nullValue="", emptyValue='""'
        ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


@dataclass(frozen=True)
class JsonSink:
    """Row objects with nulls present, as JSON arrays or as JSON lines.

    Every part file is one complete array of at most `rows_per_array` rows, which is a
    document a JSON source reads, so no file depends on the size of the table.  Spark
    writes a file for the first partition even without rows; that is an empty array then.
    """

    file_name: str = option("text", key="fileName")
    layout: str = option("select", choices=("arrays", "lines"), default="arrays")
    rows_per_array: int = option("number", key="rowsPerArray", default=ROWS_PER_ARRAY)
    keep_order: bool = True

    format = "json"
    content_type = "application/json"

    def __post_init__(self) -> None:
        file_name(self.file_name)
        check_value("select", "layout", self.layout, ("arrays", "lines"))
        whole_number(self.rows_per_array, "rowsPerArray", 1)

    def write(self, table: Table, path: str) -> None:
        df = table.ordered_frame() if self.keep_order else table.frame()
        lines = df.select(json_object(df).alias("value"))
        if self.layout == "lines":
            lines.write.mode("errorifexists").text(path)
        else:
            # One partition more without an object, for a frame that has no partition at all.
            none = df.sparkSession.range(0, 1, 1, 1).select(F.lit(None).cast("string").alias("value"))
            arrays = lines.union(none).mapInArrow(_array_writer(int(self.rows_per_array)), "value string")
            arrays.write.mode("errorifexists").option("maxRecordsPerFile", 1).text(path)


def json_object(df: DataFrame) -> F.Column:
    options = {
        "ignoreNullFields": "false",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    }
    return F.to_json(F.struct(*[col(c) for c in df.columns]), options)


def _array_writer(rows_per_array: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[str] = []
        full = False
        for batch in batches:
            for row in batch.column(0).drop_null().to_pylist():
                rows.append(row)
                if len(rows) == rows_per_array:
                    yield packed(rows)
                    rows, full = [], True
        if rows or not full and TaskContext.get().partitionId() == 0:
            yield packed(rows)

    def packed(rows: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"value": ["[" + ",".join(rows) + "]"]})

    return write


@dataclass(frozen=True)
class ParquetSink:
    """Compressed Parquet parts."""

    file_name: str = option("text", key="fileName")
    keep_order: bool = True

    format = "parquet"
    content_type = "application/vnd.apache.parquet"

    def __post_init__(self) -> None:
        file_name(self.file_name)

    def write(self, table: Table, path: str) -> None:
        df = table.ordered_frame() if self.keep_order else table.frame()
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
