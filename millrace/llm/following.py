"""The text of the next row in a global order, without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import partitions

PER_PARTITION = 4


def with_next_text(docs: DataFrame, into: str) -> DataFrame:
    """Add the text that follows in descending `id` (nulls last; ties by descending text).

    The last row is followed by the first.  Rows are cut in ranges of ids by quantiles; a
    range also gets the head of the range after it as a ghost row, so each range is a
    window of its own and the texts are shuffled once.
    """
    spark = docs.sparkSession
    count = PER_PARTITION * partitions(spark)
    shares = [i / count for i in range(1, count)]
    bounds = docs.select(F.percentile_approx("id", shares, 10 * count)).first()[0] or []
    bounds = sorted(set(bounds))
    stride = max(1, round(len(bounds) ** 0.5))
    blocks = [bounds[i : i + stride] for i in range(0, len(bounds), stride)]
    ranged = docs.withColumn("range", range_of(F.col("id"), blocks, stride))
    # Range 0 has the least ids and null; a greater range comes first.
    heads = {r["range"]: r["head"] for r in ranged.groupBy("range").agg(F.max("id").alias("head")).collect()}
    order = sorted(heads, reverse=True)
    to = {r: order[i - 1] for i, r in enumerate(order)}
    places = range(len(blocks) * stride + 1)
    head = F.get(F.array(*[F.lit(heads.get(r)).cast("long") for r in places]), F.col("range"))
    target = F.get(F.array(*[F.lit(to.get(r)).cast("int") for r in places]), F.col("range"))
    # The range before `order[0]` is the last one: its end is followed by the first row.
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(target.alias("range"), F.lit(True).alias("ghost"))
    places = F.when(head.eqNullSafe(F.col("id")), F.array(own, ghost)).otherwise(F.array(own))
    dealt = ranged.withColumn("place", F.explode(places)).select(
        "id", "text", F.col("place.range").alias("range"), F.col("place.ghost").alias("ghost")
    )
    window = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("id"), F.desc("text"))
    return dealt.withColumn(into, F.lead("text").over(window)).where("NOT ghost").drop("range", "ghost")


def range_of(value: Column, blocks: list[list[int]], stride: int) -> Column:
    """The number of bounds below `value`, by block and then within the block; null is 0."""
    if not blocks:
        return F.lit(0)
    last = F.array(*[F.lit(b[-1]) for b in blocks])
    block = F.size(F.filter(last, lambda x: x < value))
    inner = F.get(F.array(*[F.array(*map(F.lit, b)) for b in blocks]), block)
    within = F.coalesce(F.size(F.filter(inner, lambda x: x < value)), F.lit(0))
    return F.when(value.isNull(), F.lit(0)).otherwise(block * stride + F.greatest(within, F.lit(0))).cast("int")
