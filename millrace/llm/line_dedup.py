"""Removal of boilerplate lines by their frequency within a site, in DataFrame functions.

Per host, the pages that contain a line are divided by all pages of the host; lines above
a ratio go from every page of that host.  Only 64-bit line hashes are exploded, counted
with partial aggregation, so a host with a third of all pages sends each task's counts
only.  A host's boilerplate is one array of at most (distinct lines a page) / ratio hashes;
the texts meet it by host, by broadcast if its written size is below Spark's threshold,
else by a join whose hot hosts adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..table import col
from .frames import ready, renamed, written

RATIO = 0.08
MIN_PAGES = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, common): per host the hashes of its boilerplate lines."""
    hashes = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""), line_hash))
    lines = pages.select("host", F.explode(hashes).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    common = counts.join(totals, "host").where(F.col("pages") > F.col("total") * ratio)
    return common.groupBy("host").agg(F.collect_list("line").alias("common"))


def drop_boilerplate(
    docs: DataFrame,
    host_column: str = "source",
    text_column: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """All rows and columns of `docs`, the text without boilerplate lines, and
    `n_lines` and `n_dropped` (they replace columns of these names).

    Lines end at a line feed and are compared without surrounding spaces; blank lines
    stay.  A line goes if it is on at least `min_pages` pages of its host and on more than
    `ratio` of them.  Every row is a page, repeated rows too; rows without host are one
    host.  Copies count: a text copied on more pages than that loses all its lines but
    blank ones in every copy.  A null text stays null and has no lines; an empty text is one blank line.
    """
    ready(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), col(host_column).cast("string")), F.lit(""))
    hidden = next(f"__{n}" for n in range(len(docs.columns) + 1) if f"__{n}_host" not in docs.columns
                  and f"__{n}_common" not in docs.columns)
    host, common = f"{hidden}_host", f"{hidden}_common"
    pages = renamed(docs, host=host_column, text=text_column).withColumn(
        "host", F.coalesce(F.concat(F.lit("="), F.col("host").cast("string")), F.lit(""))
    )
    found = written(boilerplate(pages, ratio, min_pages), "boilerplate").toDF(host, common)
    lines = lines_of(col(text_column))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(common), line_hash(x)) | (F.trim(x) == ""))
    kept = F.when(F.col(common).isNull(), lines).otherwise(kept)
    marked = docs.withColumn(host, key).join(found, host, "left")
    size = F.coalesce(F.size(lines), F.lit(0))
    own = {
        text_column: F.array_join(kept, "\n").alias(text_column),
        "n_lines": F.when(col(text_column).isNull(), 0).otherwise(size).cast("long").alias("n_lines"),
        "n_dropped": F.when(col(text_column).isNull(), 0).otherwise(size - F.size(kept)).cast("long").alias("n_dropped"),
    }
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return marked.select(*[own.get(c, col(c)) for c in rest], own["n_lines"], own["n_dropped"])
