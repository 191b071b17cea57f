"""The 22 components a pipeline can name, with their families."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ConfigError
from ..operators.columns import DropColumns, RenameColumns, ReorderColumns, SelectColumns
from ..operators.flatten import FlattenDocument
from ..operators.rows import DeduplicateRows, FilterRows, LimitRows, SortRows
from ..operators.values import CastColumn, FillNull, NormalizeText, ReplaceValues
from ..sinks.files import CsvSink, JsonSink, ParquetSink
from ..sinks.relational import RelationalSink
from ..sources.delimited import DelimitedSource
from ..sources.documents import JsonSource
from ..sources.pages import PagedSource
from ..sources.relational import RelationalSource
from ..sources.workbook import WorkbookSource

TABULAR, DOCUMENT = "tabular", "document"
VERSION = "v1"


@dataclass(frozen=True)
class Component:
    kind: str
    config: type
    takes: str | None
    gives: str | None


# The component types of stored pipelines.
COMPONENTS = {
    "source.csv": Component("source", DelimitedSource, None, TABULAR),
    "source.json": Component("source", JsonSource, None, DOCUMENT),
    "source.xlsx": Component("source", WorkbookSource, None, TABULAR),
    "source.rest": Component("source", PagedSource, None, DOCUMENT),
    "source.postgres": Component("source", RelationalSource, None, TABULAR),
    "transform.columns.select": Component("transform", SelectColumns, TABULAR, TABULAR),
    "transform.columns.rename": Component("transform", RenameColumns, TABULAR, TABULAR),
    "transform.columns.drop": Component("transform", DropColumns, TABULAR, TABULAR),
    "transform.columns.reorder": Component("transform", ReorderColumns, TABULAR, TABULAR),
    "transform.rows.filter": Component("transform", FilterRows, TABULAR, TABULAR),
    "transform.rows.deduplicate": Component("transform", DeduplicateRows, TABULAR, TABULAR),
    "transform.rows.sort": Component("transform", SortRows, TABULAR, TABULAR),
    "transform.rows.limit": Component("transform", LimitRows, TABULAR, TABULAR),
    "transform.values.cast": Component("transform", CastColumn, TABULAR, TABULAR),
    "transform.values.replace": Component("transform", ReplaceValues, TABULAR, TABULAR),
    "transform.values.fill-null": Component("transform", FillNull, TABULAR, TABULAR),
    "transform.values.normalize-string": Component("transform", NormalizeText, TABULAR, TABULAR),
    "transform.document.flatten": Component("transform", FlattenDocument, DOCUMENT, TABULAR),
    "export.csv": Component("export", CsvSink, TABULAR, None),
    "export.json": Component("export", JsonSink, TABULAR, None),
    "export.parquet": Component("export", ParquetSink, TABULAR, None),
    "export.postgres": Component("export", RelationalSink, TABULAR, None),
}


def component(type_name: str, version: str = VERSION) -> Component:
    if version != VERSION or type_name not in COMPONENTS:
        raise ConfigError(f"There is no component {type_name} {version}.")
    return COMPONENTS[type_name]
