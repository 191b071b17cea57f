"""Tables and documents: DataFrames that remember the order of their rows.

Spark rows have no order, yet keep-first, stable sort and limit are defined by
one.  A `Table` therefore carries hidden order columns beside the visible ones.
Nothing is sorted until an operator or a sink needs it, and Catalyst prunes order
columns nobody uses down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SchemaError

HIDDEN = "__ord_"


def quoted(name: str) -> str:
    """Quote a column name so that dots and backticks stay part of it."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


@dataclass(frozen=True)
class OrderKey:
    """One hidden order column; nulls come first in both directions."""

    column: str
    descending: bool = False

    def ascending_column(self) -> Column:
        c = col(self.column)
        return c.desc_nulls_first() if self.descending else c.asc_nulls_first()

    def reversed_column(self) -> Column:
        c = col(self.column)
        return c.asc_nulls_last() if self.descending else c.desc_nulls_last()


def next_hidden(columns: Iterable[str]) -> int:
    taken = [int(c[len(HIDDEN):]) for c in columns if c.startswith(HIDDEN)]
    return max(taken, default=-1) + 1


@dataclass(frozen=True)
class Table:
    """A lazy flat table with a row order.

    `shuffled` says that an operator or the caller gave the rows an order other than
    the physical one, so a sink that keeps the order has to sort.  The rows of a file
    source are written as they are read: in order within each split of a file.
    `observe` is put on top of the frame a sink writes, above any sort: a sort reads
    its input once more to find its ranges, and would count it twice.
    """

    df: DataFrame
    order: tuple[OrderKey, ...] = ()
    shuffled: bool = False
    observe: Callable[[DataFrame], DataFrame] | None = None

    @classmethod
    def of(cls, df: DataFrame, order_by: Sequence[str] = ()) -> "Table":
        """Wrap a DataFrame; `order_by` names columns that form its row order."""
        if any(c.startswith(HIDDEN) for c in df.columns):
            raise SchemaError(f"Column names must not start with {HIDDEN}.")
        require_columns(df.columns, order_by)
        keys = [F.col(quoted(c)).alias(f"{HIDDEN}{i}") for i, c in enumerate(order_by)]
        order = tuple(OrderKey(f"{HIDDEN}{i}") for i in range(len(order_by)))
        return cls(df.select("*", *keys) if keys else df, order, shuffled=bool(order_by))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema if not f.name.startswith(HIDDEN)])

    def field(self, name: str) -> T.StructField:
        """The field of exactly this name (no case folding, no struct access)."""
        require_columns(self.columns, [name])
        return next(f for f in self.df.schema if f.name == name)

    def project(self, columns: Iterable[Column]) -> "Table":
        """Replace the visible columns and keep the order columns."""
        hidden = [col(k.column) for k in self.order]
        return replace(self, df=self.df.select(*columns, *hidden))

    def with_value(self, name: str, value: Column) -> "Table":
        """Replace one visible column in place."""
        return self.project(value.alias(name) if c == name else col(c) for c in self.columns)

    def with_tie_breaker(self) -> "Table":
        """An order column more, a hash of the visible row, behind those there are.

        Rows of one key then differ, so a sort can deal them to several tasks.
        """
        name = f"{HIDDEN}{next_hidden(self.df.columns)}"
        values = [_hashable(col(f.name), f.dataType) for f in self.schema]
        return replace(
            self,
            df=self.df.withColumn(name, F.xxhash64(*values) if values else F.lit(0).cast("long")),
            order=(*self.order, OrderKey(name)),
        )

    def apply(self, operator: Callable[["Table"], "Table"]) -> "Table":
        return operator(self)

    def frame(self) -> DataFrame:
        """The visible columns, in no particular order."""
        return self.observed(self.df.select(*[col(c) for c in self.columns]))

    def observed(self, df: DataFrame) -> DataFrame:
        return self.observe(df) if self.observe is not None else df

    def ordered_frame(self) -> DataFrame:
        """The visible columns, physically in row order."""
        return self.sorted_frame() if self.shuffled else self.frame()

    def sorted_frame(self) -> DataFrame:
        """The visible columns, sorted by the row order."""
        if not self.order:
            return self.frame()
        ordered = self.df.orderBy(*[k.ascending_column() for k in self.order])
        return self.observed(ordered.select(*[col(c) for c in self.columns]))


@dataclass(frozen=True)
class Documents:
    """Many JSON documents: one `body` text per row plus hidden order columns.

    `wrapper` names object keys that wrap the rows logically: with
    `wrapper=("pages",)` the rows with the same `group` column are the elements of
    one document `{"pages": [...]}`.  Such a document never has to exist as one
    value, so it can be larger than a task.
    """

    df: DataFrame
    order: tuple[OrderKey, ...] = ()
    wrapper: tuple[str, ...] = ()
    group: str | None = None

    @classmethod
    def of(cls, df: DataFrame, body: str, order_by: Sequence[str] = ()) -> "Documents":
        require_columns(df.columns, [body, *order_by])
        keys = [col(c).alias(f"{HIDDEN}{i}") for i, c in enumerate(order_by)]
        order = tuple(OrderKey(f"{HIDDEN}{i}") for i in range(len(order_by)))
        return cls(df.select(col(body).alias("body"), *keys), order)

    def assembled(self) -> "Documents":
        """Build every wrapped document as one value.

        The elements of a document are its pages, whose number and size the source
        bounds; use the unassembled form to flatten.
        """
        if not self.wrapper or self.group is None:
            return self
        keys = [k.column for k in self.order]
        parts = F.sort_array(F.collect_list(F.struct(*keys, "body")))
        body = F.concat(
            F.lit('{"' + self.wrapper[0] + '":['),
            F.array_join(F.transform(parts, lambda p: p["body"]), ","),
            F.lit("]}"),
        )
        name = f"{HIDDEN}0"
        grouped = self.df.groupBy(col(self.group).alias("__group")).agg(body.alias("body"))
        return Documents(
            grouped.select("body", F.col("__group").alias(name)), (OrderKey(name),)
        )


def _hashable(value: Column, data_type: T.DataType) -> Column:
    """Types that cannot be hashed count as their text."""
    text = data_type.simpleString()
    return F.to_json(value) if "map<" in text or "variant" in text else value


def require_columns(available: Iterable[str], wanted: Iterable[str]) -> None:
    known = set(available)
    missing = [c for c in wanted if c not in known]
    if missing:
        raise SchemaError(f"Columns are not available: {', '.join(missing)}.")
