"""Delimited text files as a table."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import check_value, option, relative_path, under_root
from ..errors import ConfigError, DataError, SchemaError
from ..table import HIDDEN, OrderKey, Table, col
from .promotion import promoted, promoted_types
from .quoted import left_open, lines_of, opened, records, split_parities

CORRUPT = "__corrupt"

# What Spark's parser shall give for a quoted empty field, which is a text, unlike an
# empty field without quotes, which is null: drawn anew in every process, so that no
# file can hold it.
EMPTY_TEXT = f"\ufdd0{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Files:
    """A path or files that are read by lines, files read whole, and records of the others."""

    plain: str | list[str] | None = None
    whole: str | list[str] | None = None
    records: DataFrame | None = None
    split: list[str] | None = None


@dataclass(frozen=True)
class DelimitedSource:
    """Read delimited text: a file, a directory or a glob below the input root.

    Empty fields are null.  One extra pass decides the column types over all rows
    and checks that every row has the right number of fields.  Files are split
    among tasks, also those with quoted fields that hold line breaks: a cheap pass
    finds these out and counts the quotes of each split.  Pass `multi_line` to skip it.
    """

    source_path: str = option("text", key="sourcePath")
    has_header: bool = option("boolean", key="hasHeader", default=True)
    separator: str = option("text", default=",")
    multi_line: bool | None = None

    def __post_init__(self) -> None:
        relative_path(self.source_path)
        check_value("boolean", "hasHeader", self.has_header)
        if not isinstance(self.separator, str) or len(self.separator) != 1:
            raise ConfigError("separator must be one character.")

    def __call__(self, spark: SparkSession, root: str) -> Table:
        path = under_root(root, relative_path(self.source_path))
        try:
            return self._read(spark, path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error.getCondition()):
                raise DataError("The delimited source is not available.") from None
            raise

    def _read(self, spark: SparkSession, path: str) -> Table:
        files = self._by_line_breaks(spark, path)
        names = self._names(spark, files)
        if any(n.startswith("__") for n in names):
            raise SchemaError("Column names of a delimited source must not start with __.")
        fields = [T.StructField(n, T.StringType()) for n in names]
        checked = self._rows(spark, files, T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]))
        texts = checked.select(*[_with_empty_texts(n) for n in names], CORRUPT)
        types, (corrupt,) = promoted_types(texts, names, F.count(col(CORRUPT)))
        if corrupt:
            raise DataError("The delimited source has rows with another number of fields.")
        # A column that is not text has no empty texts.
        columns = [
            _with_empty_texts(n) if types[n] == "string" else promoted(n, types[n]) for n in names
        ]
        return _in_file_order(self._rows(spark, files, T.StructType(fields)), columns)

    def _by_line_breaks(self, spark: SparkSession, path: str) -> Files:
        """How each file is read: those with fields over several lines by records.

        A line with an odd number of quotes opens or closes such a field.  A file in
        which quotes stand elsewhere too is left to the parser, in one task.
        """
        if self.multi_line is not None:
            return Files(whole=path) if self.multi_line else Files(plain=path)
        lines = lines_of(spark).text(path)
        splits = split_parities(lines)  # of splits, which the driver plans anyway
        broken = {s.uri for s in splits if s.broken}
        if not broken:
            return Files(plain=path)
        whole = left_open(splits)
        plain = [f for f in lines.inputFiles() if f not in broken]
        names = {s.uri: s.file for s in splits}
        split = sorted(broken - whole)
        found = None
        if split:
            found = records(spark, _as_globs(split), opened(splits), self.separator)
            stray = {r.file for r in found.where("stray").select("file").distinct().collect()}
            whole |= {f for f in split if names[f] in stray}
            found = found.where(~F.col("file").isin(sorted(stray))) if stray else found
            split = [f for f in split if f not in whole]
        return Files(plain, sorted(whole), found if split else None, split)

    def _rows(self, spark: SparkSession, files: Files, schema: T.StructType) -> DataFrame:
        """The records of all files with the place of each."""
        parts = [
            _loaded(self._reader(spark, multi_line).schema(schema), paths).select("*", *_place())
            for multi_line, paths in ((False, files.plain), (True, files.whole))
            if paths
        ]
        if files.records is not None:
            parts.append(self._parsed(spark, files.records, schema))
        return reduce(DataFrame.unionByName, parts)

    def _parsed(self, spark: SparkSession, found: DataFrame, schema: T.StructType) -> DataFrame:
        """Records parsed one by one; the first of each file has to be the header, if there is one."""
        options = {k: str(v) for k, v in self._options(True).items() if k not in ("header", "enforceSchema")}
        names = [f.name for f in schema]
        fields = ", ".join(f"`{CORRUPT if n == CORRUPT else f'_{i}'}` string" for i, n in enumerate(names))
        values = found.select("*", F.from_csv("record", fields, options).alias("__values"))
        parsed = [F.col("__values")[CORRUPT if n == CORRUPT else f"_{i}"].alias(n) for i, n in enumerate(names)]
        place = [F.col(c).alias(f"{HIDDEN}{i}") for i, c in enumerate(("file", "start", "place"))]
        if self.has_header:
            header = [n for n in names if n != CORRUPT]
            same = reduce(Column.__and__, [F.col("__values")[f"_{i}"].eqNullSafe(F.lit(n)) for i, n in enumerate(header)])
            other = F.raise_error(F.lit("A header differs from the first file's."))
            values = values.where(F.when(~F.col("first"), True).when(same, False).otherwise(other.cast("boolean")))
        return values.select(*parsed, *place)

    def _names(self, spark: SparkSession, files: Files) -> list[str]:
        """The column names, from the first record; Spark would repair doubtful ones."""
        multi_line, paths = (False, files.plain) if files.plain else (True, files.whole or files.split)
        first = _loaded(self._reader(spark, multi_line).option("header", False), paths)
        if not first.columns:
            raise DataError("The delimited source is empty.")
        if not self.has_header:
            return [f"column_{i + 1}" for i in range(len(first.columns))]
        names = list(first.head(1)[0])
        if None in names or EMPTY_TEXT in names or len(set(names)) != len(names):
            raise SchemaError("The header has empty or repeated names.")
        return names

    def _reader(self, spark: SparkSession, multi_line: bool) -> DataFrameReader:
        return spark.read.options(**self._options(multi_line))

    def _options(self, multi_line: bool) -> dict:
        return dict(
            header=self.has_header,
            sep=self.separator,
            quote='"',
            escape='"',
            multiLine=multi_line,
            enforceSchema=not self.has_header,
            mode="PERMISSIVE",
            nullValue="",
            emptyValue=EMPTY_TEXT,
            columnNameOfCorruptRecord=CORRUPT,
        )


def _place() -> list[Column]:
    """Where a record stands: file, split and place; the last alone mixes splits."""
    keys = [
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    ]
    return [k.alias(f"{HIDDEN}{i}") for i, k in enumerate(keys)]


def _as_globs(uris: list[str]) -> list[str]:
    """Files by their encoded names."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(p)) for p in uris]


def _loaded(reader: DataFrameReader, paths: list[str] | str) -> DataFrame:
    """A path or glob as it was given, or files by their encoded names."""
    return reader.csv(paths if isinstance(paths, str) else _as_globs(paths))


def _with_empty_texts(name: str) -> Column:
    return F.when(col(name) == EMPTY_TEXT, F.lit("")).otherwise(col(name)).alias(name)


def _in_file_order(df: DataFrame, columns: list) -> Table:
    """The rows in the order of their places."""
    order = tuple(OrderKey(f"{HIDDEN}{i}") for i in range(3))
    return Table(df.select(*columns, *[k.column for k in order]), order)
