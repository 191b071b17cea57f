"""Bottom-k sketches of word shingles, in DataFrame functions.

A fingerprint is the ascending list of the `SKETCH` least 64-bit hashes of a text's
distinct shingles.  Sketches of parts merge to the sketch of the whole: the least hashes
of the union.  Two sketches estimate resemblance, containment and distinct shingle counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..table import col
from .frames import text_of

WORDS = 5
SKETCH = 128
BLANKS = r"[\x20\x09-\x0D]+"
SPAN = float(1 << 64)


def with_sketch(df: DataFrame, text_column: str, into: str, words: int = WORDS, size: int = SKETCH) -> DataFrame:
    """Add the sketch of a text as an array of ascending longs.

    Fewer than `words` words are one shingle; no words, or null, have an empty sketch.
    """
    hidden = f"__{into}_words"
    tokens = F.array_remove(F.split(text_of(text_column), BLANKS), "")
    df = df.withColumn(hidden, F.transform(tokens, lambda w: F.xxhash64(w)))
    hashes = col(hidden)
    count = F.size(hashes)

    def shingle(first: Column, at: Column) -> Column:
        return F.xxhash64(first, *[F.get(hashes, at + i) for i in range(1, words)])

    all_shingles = F.transform(F.slice(hashes, F.lit(1), count - (words - 1)), shingle)
    least = F.slice(F.sort_array(F.array_distinct(all_shingles)), 1, size)
    few = F.when(count > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(into, F.when(count >= words, least).otherwise(few)).drop(hidden)


def as_text(sketch: Column) -> Column:
    """The sketch as a string; equal sketches and only they are equal strings."""
    return F.array_join(sketch.cast("array<string>"), ",")


def merged(a: Column, b: Column, size: int = SKETCH) -> Column:
    """The sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Estimated Jaccard likeness, 0 to 1; two empty sketches are alike."""
    union = merged(a, b, size)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(sketch: Column, size: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    share = (F.element_at(sketch, -1).cast("double") + SPAN / 2) / SPAN
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SKETCH) -> Column:
    """Estimated share of the shingles of `a` that `b` has too; null if `a` has none."""
    common = resemblance(a, b, size) * distinct_shingles(merged(a, b, size), size)
    of = distinct_shingles(a, size)
    return F.when(of > 0, F.least(F.lit(1.0), common / of))


def merge_parts(df: DataFrame, key: str, sketch: str, size: int = SKETCH) -> DataFrame:
    """One sketch per key from the sketches of its parts (rows).

    Hashes are made distinct with partial aggregation and ranked with a limit before and
    after the shuffle, so a key with a third of all parts sends `size` hashes a task.
    """
    hashes = df.select(col(key).alias("key"), F.explode(col(sketch)).alias("hash")).distinct()
    rank = F.row_number().over(Window.partitionBy("key").orderBy("hash"))
    least = hashes.withColumn("rank", rank).where(F.col("rank") <= size)
    merged_ = least.groupBy("key").agg(F.sort_array(F.collect_list("hash")).alias("sketch"))
    keys = df.select(col(key).alias("key")).distinct()
    return keys.join(merged_, keys["key"].eqNullSafe(merged_["key"]), "left").select(
        keys["key"].alias(key), F.coalesce("sketch", F.array().cast("array<bigint>")).alias(sketch)
    )
