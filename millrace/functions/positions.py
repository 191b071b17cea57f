"""Row positions without bringing all rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import functions as F

from ..session import scratch_path, small_frame
from ..sources.dataset import scan
from ..table import Table, col


def numbered(table: Table, name: str) -> Table:
    """The table with the place of each row, counted from 0 (two actions).

    The rows are range-partitioned, sorted and written once, one file per task.  A
    row's place is the number of rows in the files before its own plus its number in
    the file.  Only the file sizes, two numbers per task of the sort, are totalled on
    the driver; they come back as a local relation whose exact size lets Catalyst
    decide about a broadcast.
    """
    spark = table.df.sparkSession
    path = scratch_path(spark, "ordered")
    table.sorted_frame().write.option("maxRecordsPerFile", 0).parquet(path)
    rows = scan(spark, path)
    part, _, row = (k.column for k in rows.order)
    sizes = sorted(rows.df.groupBy(part).agg(F.count(F.lit(1))).collect())
    before = accumulate((size for _, size in sizes), initial=0)
    offsets = [(number, start) for (number, _), start in zip(sizes, before)]
    starts = small_frame(spark, offsets, f"{part} int, __before bigint")
    placed = rows.df.join(starts, part)
    position = (F.col("__before") + col(row)).alias(name)
    visible = [col(c) for c in rows.columns]
    return Table(placed.select(*visible, position, *[k.column for k in rows.order]), rows.order, True)
