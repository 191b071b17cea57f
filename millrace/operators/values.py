"""Value operators: each rewrites one column in place with built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import functions as F

from ..config import check_value, column_name, option, scalar
from ..errors import ConfigError, SchemaError
from ..functions import casts, text
from ..functions.typed import Scalar, as_text, class_of, fitting_literal, literal_as
from ..session import small_frame
from ..table import HIDDEN, Table, col, next_hidden

BRANCHES = 32
OPERATIONS = ("trim", "lowercase", "uppercase", "normalizeWhitespace")


@dataclass(frozen=True)
class CastColumn:
    """Cast a column to text, integer, float, boolean, date or datetime.

    Strict casts fail on the first value that does not convert; others yield null.
    The failure is raised by the rows that reach an output: like every Spark
    expression, a cast whose column or row is dropped later is not evaluated.
    """

    column: str = option("text")
    data_type: str = option("select", choices=tuple(casts.TARGETS))
    strict: bool = option("boolean", default=True)

    def __post_init__(self) -> None:
        column_name(self.column)
        check_value("select", "data_type", self.data_type, tuple(casts.TARGETS))
        check_value("boolean", "strict", self.strict)

    def __call__(self, table: Table) -> Table:
        field = table.field(self.column)
        value = casts.convert(
            col(self.column), field.dataType, self.data_type, strict=self.strict, name=self.column
        )
        return table.with_value(self.column, value)


@dataclass(frozen=True)
class ReplaceValues:
    """Replace values by a map, all at once; the column keeps its type.

    A long map of texts is a table that Catalyst joins, instead of a branch per entry.
    """

    column: str = option("text")
    replacements: dict[str, Scalar] = option("json")

    def __post_init__(self) -> None:
        column_name(self.column)
        if not isinstance(self.replacements, dict) or not self.replacements:
            raise ConfigError("replacements must be a non-empty object.")
        for key, value in self.replacements.items():
            if not isinstance(key, str):
                raise ConfigError("replacements must be keyed by text.")
            scalar(value, "replacements")

    def __call__(self, table: Table) -> Table:
        field = table.field(self.column)
        if class_of(field.dataType) == "text" and len(self.replacements) > BRANCHES:
            return self._looked_up(table)
        value: Any = F
        for old, new in self.replacements.items():
            value = value.when(col(self.column) == literal_as(field, old), literal_as(field, new))
        return table.with_value(self.column, value.otherwise(col(self.column)))


    def _looked_up(self, table: Table) -> Table:
        start = next_hidden(table.df.columns)
        old, new = f"{HIDDEN}{start}", f"{HIDDEN}{start + 1}"
        pairs = [(key, as_text(value)) for key, value in self.replacements.items()]
        entries = small_frame(table.df.sparkSession, pairs, f"{old} string, {new} string")
        joined = replace(table, df=table.df.join(entries, col(self.column) == F.col(old), "left"))
        return joined.with_value(self.column, F.coalesce(F.col(new), col(self.column)))


@dataclass(frozen=True)
class FillNull:
    """Replace nulls by a value; a fraction widens an integer column to float."""

    column: str = option("text")
    value: Scalar = option("json")

    def __post_init__(self) -> None:
        column_name(self.column)
        scalar(self.value, "value")

    def __call__(self, table: Table) -> Table:
        field = table.field(self.column)
        fill = fitting_literal(field, self.value)
        return table.with_value(self.column, F.coalesce(col(self.column), fill))


@dataclass(frozen=True)
class NormalizeText:
    """Trim, lower, upper or collapse white space; other types become text first."""

    column: str = option("text")
    operation: str = option("select", choices=OPERATIONS)

    def __post_init__(self) -> None:
        column_name(self.column)
        check_value("select", "operation", self.operation, OPERATIONS)

    def __call__(self, table: Table) -> Table:
        field = table.field(self.column)
        if class_of(field.dataType) == "other":
            raise SchemaError(f"Column {self.column} has no text form.")
        value = casts.as_text(col(self.column), field.dataType)
        return table.with_value(self.column, text.normalize(value, self.operation))
