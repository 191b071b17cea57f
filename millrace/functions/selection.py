"""The first rows of a table, found by counts per key range; the rows never meet in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..table import HIDDEN, OrderKey, Table, col, next_hidden

ROUNDS = 2
PART_BITS = 33  # monotonically_increasing_id counts the rows of a task in its low 33 bits


def precedes(a: Column, b: Column, descending: bool) -> Column:
    """Whether `a` comes strictly before `b`; nulls come first in both directions."""
    plain = F.coalesce(a > b if descending else a < b, F.lit(False))
    return (a.isNull() & b.isNotNull()) | plain


def up_to(order: tuple[OrderKey, ...], bound: Column) -> Column:
    """Rows whose order columns come before those of `bound`, or equal them."""

    def step(rest: Column, key: OrderKey) -> Column:
        a, b = col(key.column), bound[key.column]
        return precedes(a, b, key.descending) | (a.eqNullSafe(b) & rest)

    return reduce(step, reversed(order), F.lit(True))


def counted_ranges(keys: DataFrame, order: tuple[OrderKey, ...], ranges: int) -> DataFrame:
    """Per range of the row order: its number, its rows, and the order columns of its last row.

    Only order columns travel.  A task numbers its sorted rows, so the greatest number
    marks its last row.
    """
    by = [k.ascending_column() for k in order]
    place = f"{HIDDEN}place"
    dealt = keys.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    dealt = dealt.withColumn(place, F.monotonically_increasing_id())
    last = F.max_by(F.struct(*[col(k.column) for k in order]), place)
    return dealt.groupBy(F.shiftright(place, PART_BITS).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), last.alias("last")
    )


def cut(sizes: DataFrame, wanted: Column) -> Column:
    """A subquery of one row: `low`, the last key of the ranges that `wanted` rows hold whole,
    `taken`, their rows, and `high`, the last key of the range after them."""
    so_far = F.sum("n").over(Window.orderBy("part"))
    whole = F.col("so_far") <= F.col("wanted")
    found = sizes.select("part", "last", so_far.alias("so_far"), wanted.alias("wanted")).agg(
        F.max_by(F.when(whole, F.col("last")), F.when(whole, F.col("part"))).alias("low"),
        F.coalesce(F.max(F.when(whole, F.col("so_far"))), F.lit(0)).alias("taken"),
        F.min_by(F.when(~whole, F.col("last")), F.when(~whole, F.col("part"))).alias("high"),
    )
    return found.select(F.struct("low", "taken", "high")).scalar()


def first_rows(table: Table, count: int) -> Table:
    """The first `count` rows in row order, lazily and in as many tasks as the table has.

    The keys are dealt to ranges and counted; ranges that the count holds whole are kept
    whole, by comparing keys as the rows are read.  The range it cuts is dealt and counted
    again, and what the second cut leaves, a share of about one row in the square of
    `spark.sql.shuffle.partitions`, is ranked.  Bounds are scalar subqueries of one row, so
    no action runs here.  Rows equal in all order columns are taken as they come; a table
    without order is ordered by a hash of its rows.
    """
    hidden = list(table.df.columns)
    if not table.order:
        table = table.with_tie_breaker()
    order = table.order
    ranges = int(table.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = table.df.select(*[col(k.column) for k in order])
    wanted = F.lit(count).cast("long")
    bounds: list[tuple[str, Column]] = []

    def held(bound: Column) -> Column:
        return F.coalesce(bound.isNotNull() & up_to(order, bound), F.lit(False))

    def bounded(df: DataFrame, below: bool) -> DataFrame:
        """Rows of the whole ranges, or of the range cut last."""
        kept, inside = F.lit(False), F.lit(True)
        for name, found in bounds:
            df = df.withColumn(name, found)
            # As a lambda's variable a bound is in the condition once, however many columns it compares.
            one = F.array(col(name))
            kept = kept | F.exists(one, lambda f: held(f["low"]))
            inside = inside & F.exists(one, lambda f: ~held(f["low"]) & held(f["high"]))
        return df.where(kept if below else inside).drop(*[name for name, _ in bounds])

    for step in range(ROUNDS):
        found = cut(counted_ranges(bounded(keys, False), order, ranges), wanted)
        bounds.append((f"{HIDDEN}bound{step}", found))
        wanted = wanted - found["taken"]
    rank = f"{HIDDEN}{next_hidden(table.df.columns)}"
    by = Window.orderBy(*[k.ascending_column() for k in order])
    rest = bounded(table.df, False).withColumn(rank, F.row_number().over(by)).where(col(rank) <= wanted)
    kept = bounded(table.df, True).unionByName(rest.drop(rank)).select(*[col(c) for c in hidden])
    return Table(kept, tuple(k for k in order if k.column in hidden), table.shuffled, table.observe)
