"""Declarative data-preparation pipelines as lazy Spark plans."""

from .errors import ConfigError, DataError, MillraceError, SchemaError
from .operators.columns import DropColumns, RenameColumns, ReorderColumns, SelectColumns
from .operators.flatten import FlattenDocument
from .operators.rows import DeduplicateRows, FilterRows, LimitRows, SortRows
from .operators.values import CastColumn, FillNull, NormalizeText, ReplaceValues
from .session import prepare
from .table import Documents, OrderKey, Table

__all__ = [
    "CastColumn",
    "ConfigError",
    "DataError",
    "DeduplicateRows",
    "Documents",
    "DropColumns",
    "FillNull",
    "FilterRows",
    "FlattenDocument",
    "LimitRows",
    "MillraceError",
    "NormalizeText",
    "OrderKey",
    "RenameColumns",
    "ReorderColumns",
    "ReplaceValues",
    "SchemaError",
    "SelectColumns",
    "SortRows",
    "Table",
    "prepare",
]
