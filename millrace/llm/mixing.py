"""Mixing sources to target weights by fitting a subset sum of document lengths.

Each source gets a budget of words.  Its documents are counted by exact length; the
counts, not the documents, go through a bounded-knapsack fit: a share of every length
first, single documents until little is left, then dynamic programming over the words
that remain.  Documents of a length are interchangeable, so the number chosen of a length
is taken from the documents with the least seeded hash.

Counts are aggregated before they move.  Documents of one length are ranked within one of
`BUCKETS` hash ranges, so a length with a third of all documents is many windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..table import col
from .frames import ready, same_row, text_of, with_row_keys, with_row_name, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 20
BUCKETS = 4096
FIT_WORDS = 1 << 15


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(key, source, source_size, target): budgets in proportion to weights, capped.

    One row per source is all that meets in one task.  Sources in code point order, null
    last, take the weights in turn.  With sources ordered by cap over weight, those whose
    cap is below the level of what is left are full; the level of the rest follows.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    frame = sources.withColumn("place", place).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    frame = frame.withColumn("all_words", F.sum("source_size").over(whole) * share)
    frame = frame.withColumn("all_weight", F.sum("weight").over(whole))
    left = F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    frame = frame.withColumn("full", F.col("most") * weight_left < F.col("weight") * left)
    # A full source after one that is not would be a rounding slip; the first decides.
    frame = frame.withColumn("full", F.min("full").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    free_words = F.first("all_words").over(whole) - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(whole), F.lit(0.0))
    free_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), free_words * F.col("weight") / free_weight))
    return frame.select("key", "source", "source_size", target.alias("target"))


def nearest(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each size come nearest to `budget`, from below or above.

    What is above leaves out documents that fit into the rest of all words from below.
    """
    below = fitted(sizes, counts, budget, seed)
    total, short = int(np.dot(sizes, counts)), budget - int(np.dot(sizes, below))
    if short <= 0 or total <= budget:
        return below
    above = counts - fitted(sizes, counts, total - budget, seed)
    return below if short <= int(np.dot(sizes, above)) - budget else above


def fitted(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each size (all > 0, distinct) sum to `budget`, or just below.

    The sum is exact whenever the dynamic program reaches it.
    """
    total = int(np.dot(sizes, counts))
    budget = min(budget, total)
    if budget <= 0:
        return np.zeros(len(sizes), dtype=np.int64)
    taken = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int(np.dot(sizes, taken))
    order = np.random.default_rng(seed).permutation(len(sizes))
    while rest > FIT_WORDS:
        progress = False
        for i in order:
            size = int(sizes[i])
            if taken[i] < counts[i] and size <= rest and rest > FIT_WORDS:
                taken[i] += 1
                rest -= size
                progress = True
        if not progress:
            break
    goal = 1 << rest
    reach, history = 1, []
    mask = (goal << 1) - 1
    for i in order:
        size, spare, step = int(sizes[i]), int(counts[i] - taken[i]), 1
        spare = min(spare, rest // size)
        while spare > 0 and not reach & goal:
            step = min(step, spare)
            history.append((i, step, reach))
            reach |= (reach << (size * step)) & mask
            spare -= step
            step *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    for i, step, before in reversed(history):
        if not before >> at & 1:
            taken[i] += step
            at -= step * int(sizes[i])
    return taken


def fit_group(seed: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ignore_index=True)
        taken = nearest(frame["size"].to_numpy(), frame["docs"].to_numpy(), int(frame["budget"].iloc[0]), seed)
        return pd.DataFrame({"key": frame["key"], "size": frame["size"], "chosen": taken})

    return run


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = SEED,
) -> DataFrame:
    """Per row: `id`, `source`, `size` (words), `source_size`, `target` and `copies`.

    `share` times all words is dealt to the sources by weight, none above `cap` times its
    own; a document is taken floor(target / source size) times, and once more if chosen.
    Null text has no words; null source is a source, the last.  Null ids and repeated rows
    are documents like others; which of equal rows is taken cannot be told apart.
    """
    ready(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sized = docs.select(
        col(id_column).alias("id"), col(source_column).cast("string").alias("source"),
        word_count(text_of(text_column)).alias("size"),
    )
    order = F.xxhash64(F.lit(seed), F.col("id"), F.col("source"))
    sized = sized.withColumn("key", key).withColumn("order", order)
    sized = written(sized.withColumn("bucket", F.pmod("order", F.lit(BUCKETS))), "sizes")
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    budgets = targets(sources, weights, share, cap).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    budgets = written(budgets.withColumn(
        "budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    ), "budgets")
    cells = written(sized.where("size > 0").groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("docs")), "cells")
    lengths = cells.groupBy("key", "size").agg(F.sum("docs").alias("docs"))
    chosen = (
        lengths.join(budgets.select("key", "budget"), "key")
        .groupBy("key").applyInPandas(fit_group(seed), "key string, size long, chosen long").where("chosen > 0")
    )
    before = F.sum("docs").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    quota = F.least(F.col("chosen") - F.coalesce("before", F.lit(0)), F.col("docs"))
    quotas = cells.withColumn("before", before).join(chosen, ["key", "size"]).select("key", "size", "bucket", quota.alias("quota"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("order", "id"))
    ranked = sized.withColumn("rank", rank).join(quotas.where("quota > 0"), ["key", "size", "bucket"], "left")
    extra = F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)
    return ranked.join(budgets.drop("source"), "key").select(
        "id", "source", "size", "source_size", "target", (F.col("whole") + extra).alias("copies")
    )


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, with all columns."""
    ready(docs.sparkSession)
    named, name = with_row_name(docs, id_column, text_column)
    taken = mix(named, name, text_column, **options).where("copies > 0")
    taken = taken.groupBy(F.col("id").alias("taken")).agg(F.sum("copies").cast("int").alias("taken_copies"))
    taken, taken_row, taken_check = with_row_keys(taken, "taken")
    named, row, check = with_row_keys(named, name)
    # Rows equal in id and text are one row here, as often as all of them are taken.
    chosen = named.join(taken, same_row(row, check, taken_row, taken_check)).dropDuplicates([row, check])
    copies = F.explode(F.sequence(F.lit(1), F.col("taken_copies"))).alias("taken_copy")
    return chosen.select(*[col(c) for c in docs.columns], copies).drop("taken_copy")
