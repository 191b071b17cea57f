"""Column operators: pure projections, so Catalyst prunes the scan to what is kept."""

from __future__ import annotations

from dataclasses import dataclass

from ..config import name_list, option
from ..errors import ConfigError, SchemaError
from ..table import HIDDEN, Table, col, require_columns


@dataclass(frozen=True)
class SelectColumns:
    """Keep the listed columns in the listed order."""

    columns: list[str] = option("json")

    def __post_init__(self) -> None:
        name_list(self.columns, "columns", at_least=1)

    def __call__(self, table: Table) -> Table:
        require_columns(table.columns, self.columns)
        return table.project(col(c) for c in self.columns)


@dataclass(frozen=True)
class RenameColumns:
    """Rename columns at once, so that a swap is possible."""

    renames: dict[str, str] = option("json")

    def __post_init__(self) -> None:
        if not isinstance(self.renames, dict):
            raise ConfigError("renames must be an object.")
        name_list(list(self.renames), "renames", at_least=0)
        name_list(list(self.renames.values()), "rename targets", at_least=0)
        if any(target.startswith(HIDDEN) for target in self.renames.values()):
            raise ConfigError(f"Rename targets must not start with {HIDDEN}.")

    def __call__(self, table: Table) -> Table:
        require_columns(table.columns, self.renames)
        kept = set(table.columns) - set(self.renames)
        if kept & set(self.renames.values()):
            raise SchemaError("A rename target is already the name of another column.")
        return table.project(col(c).alias(self.renames.get(c, c)) for c in table.columns)


@dataclass(frozen=True)
class DropColumns:
    """Remove the listed columns; a missing one is an error."""

    columns: list[str] = option("json")

    def __post_init__(self) -> None:
        name_list(self.columns, "columns", at_least=0)

    def __call__(self, table: Table) -> Table:
        require_columns(table.columns, self.columns)
        gone = set(self.columns)
        return table.project(col(c) for c in table.columns if c not in gone)


@dataclass(frozen=True)
class ReorderColumns:
    """Put the listed columns first; the others keep their order behind them."""

    columns: list[str] = option("json")

    def __post_init__(self) -> None:
        name_list(self.columns, "columns", at_least=0)

    def __call__(self, table: Table) -> Table:
        require_columns(table.columns, self.columns)
        first = set(self.columns)
        rest = [c for c in table.columns if c not in first]
        return table.project(col(c) for c in [*self.columns, *rest])
