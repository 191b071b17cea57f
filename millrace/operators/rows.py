"""Row operators: filter, deduplicate, sort and limit."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..config import check_value, column_name, name_list, option, scalar, whole_number
from ..errors import ConfigError, SchemaError
from ..functions.selection import first_rows
from ..functions.typed import Scalar, fitting_literal
from ..table import HIDDEN, OrderKey, Table, col, next_hidden, require_columns

COMPARISONS = {
    "equals": lambda a, b: a == b,
    "notEquals": lambda a, b: a != b,
    "greaterThan": lambda a, b: a > b,
    "greaterThanOrEqual": lambda a, b: a >= b,
    "lessThan": lambda a, b: a < b,
    "lessThanOrEqual": lambda a, b: a <= b,
}
NULL_CHECKS = {"isNull": Column.isNull, "isNotNull": Column.isNotNull}
KEEP = ("first", "last", "none")

# Groups of each level of a large limit, and the count up to which it needs no tree.
FANS = (512, 32)
FEW_ROWS = 1000
# The most rows that may meet in the last task of a limit; larger limits are cut by ranges.
MET_ROWS = 1_000_000


@dataclass(frozen=True)
class FilterRows:
    """Keep rows that satisfy one predicate; nulls never satisfy a comparison.

    The predicate compares the bare column with a literal, so it reaches the scan.
    """

    column: str = option("text")
    operator: str = option("select", choices=(*COMPARISONS, *NULL_CHECKS))
    value: Scalar | None = option("json", default=None)

    def __post_init__(self) -> None:
        column_name(self.column)
        check_value("select", "operator", self.operator, (*COMPARISONS, *NULL_CHECKS))
        if self.operator in NULL_CHECKS:
            if self.value is not None:
                raise ConfigError("Null checks take no value.")
        else:
            scalar(self.value, "value")

    def __call__(self, table: Table) -> Table:
        field = table.field(self.column)
        if self.operator in NULL_CHECKS:
            predicate = NULL_CHECKS[self.operator](col(self.column))
        else:
            literal = fitting_literal(field, self.value)
            predicate = COMPARISONS[self.operator](col(self.column), literal)
        return replace(table, df=table.df.where(predicate))


@dataclass(frozen=True)
class DeduplicateRows:
    """Keep the first row, the last row, or no row of keys that occur repeatedly.

    A key may hold any share of the rows: `first` and `last` are ranked before the
    shuffle too (a window group limit), and `none` is a grouped aggregate with a
    partial step, so a task sends at most one row per key.
    """

    columns: list[str] | None = option("json", default=None)
    keep: str = option("select", choices=KEEP, default="first")

    def __post_init__(self) -> None:
        if self.columns is not None:
            name_list(self.columns, "columns", at_least=1)
        check_value("select", "keep", self.keep, KEEP)

    def __call__(self, table: Table) -> Table:
        keys = self.columns if self.columns is not None else table.columns
        require_columns(table.columns, keys)
        if self.keep == "none":
            return replace(table, df=self._singles(table, keys), shuffled=True)
        if not table.order:
            raise SchemaError("Keeping the first or last row needs a table with a row order.")
        order = [
            k.reversed_column() if self.keep == "last" else k.ascending_column()
            for k in table.order
        ]
        rank = f"{HIDDEN}{next_hidden(table.df.columns)}"
        window = Window.partitionBy(*[col(c) for c in keys]).orderBy(*order)
        ranked = table.df.withColumn(rank, F.row_number().over(window))
        return replace(table, df=ranked.where(col(rank) == 1).drop(rank), shuffled=True)

    @staticmethod
    def _singles(table: Table, keys: list[str] | tuple[str, ...]) -> Any:
        # A group of one row: `first` of each other column is that row.
        count = f"{HIDDEN}{next_hidden(table.df.columns)}"
        key_set = set(keys)
        others = [c for c in table.df.columns if c not in key_set]
        grouped = table.df.groupBy(*[col(c) for c in keys]).agg(
            F.count(F.lit(1)).alias(count), *[F.first(col(c)).alias(c) for c in others]
        )
        return grouped.where(col(count) == 1).select(*[col(c) for c in table.df.columns])


@dataclass(frozen=True)
class SortRows:
    """A stable sort by several columns; nulls come first in both directions.

    The keys become the leading order columns, so later changes of the visible
    columns do not disturb the order and a following limit is a top-k.
    """

    columns: list[dict[str, Any]] = option("json")

    def __post_init__(self) -> None:
        if not isinstance(self.columns, list | tuple) or not self.columns:
            raise ConfigError("columns must list at least one sort key.")
        for key in self.columns:
            if not isinstance(key, dict) or set(key) - {"column", "descending"}:
                raise ConfigError("A sort key has a column and an optional descending flag.")
            check_value("boolean", "descending", key.get("descending", False))
        name_list([key.get("column") for key in self.columns], "columns", at_least=1)

    def __call__(self, table: Table) -> Table:
        require_columns(table.columns, [key["column"] for key in self.columns])
        start = next_hidden(table.df.columns)
        keys = tuple(
            OrderKey(f"{HIDDEN}{start + i}", key.get("descending", False))
            for i, key in enumerate(self.columns)
        )
        copies = [col(k["column"]).alias(o.column) for k, o in zip(self.columns, keys)]
        if not table.order:
            table = table.with_tie_breaker()
            keys = tuple(
                OrderKey(f"{HIDDEN}{start + 1 + i}", key.descending) for i, key in enumerate(keys)
            )
            copies = [col(k["column"]).alias(o.column) for k, o in zip(self.columns, keys)]
        return Table(table.df.select("*", *copies), keys + table.order, shuffled=True)


@dataclass(frozen=True)
class LimitRows:
    """The first `count` rows in row order.

    Spark brings the rows of a limit together in one task, `count` from every task
    before it.  So that this is a bounded multiple of `count`, a tree of group limits
    stands in front of it: rows are dealt to fewer and fewer groups, each of which keeps
    its first `count`, before and after its shuffle.  Above `MET_ROWS` rows, with an order
    or without, the last row is found by counts per key range instead and rows up to it
    are kept where they are read.  The plan stays lazy for any count.
    """

    count: int = option("number")

    def __post_init__(self) -> None:
        whole_number(self.count, "count", 0)

    def __call__(self, table: Table) -> Table:
        count = int(self.count)
        if count > MET_ROWS:
            return first_rows(table, count)
        if count == 0 or not table.order:
            return replace(table, df=table.df.limit(count))
        order = [k.ascending_column() for k in table.order]
        group, rank = (f"{HIDDEN}{next_hidden(table.df.columns) + i}" for i in range(2))
        # A few rows of every task are less than the shuffles of the tree.
        fans = FANS if count > FEW_ROWS else ()
        dealt = table.df.withColumn(group, F.xxhash64(*[col(k.column) for k in table.order]))
        for groups in fans:
            window = Window.partitionBy(F.pmod(col(group), F.lit(groups))).orderBy(*order)
            dealt = dealt.withColumn(rank, F.row_number().over(window)).where(col(rank) <= count)
        return replace(table, df=dealt.drop(group, rank).orderBy(*order).limit(count))
