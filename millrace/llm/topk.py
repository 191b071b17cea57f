"""Exact top-k by inner product over a pivot-distance index.

Components become integers floor(scale * x).  With M the greatest squared norm, a vector x
gains the coordinate sqrt(M - |x|^2) and a query the coordinate 0; then the squared
distance of a query and a vector is |q|^2 + M - 2 * score, so the nearest vectors are those
of the highest scores and the triangle inequality holds.  Vectors are keyed by their
nearest pivot and the distance to it: per pivot, annuli of ascending distance.  A query
first searches the annulus its own distance falls in, which gives it a k-th score; then it
goes to the annuli whose bound, from the distances to their pivot, can still reach that
score, and to no other.  Distances are those of vectors divided by the greatest component,
so no square is beyond the range of a float; the scores themselves are exact integers.

Pivots come from at most `SAMPLE` vectors; every vector is indexed.  Annuli are cut in
blocks of about `BLOCK` vectors by a hash of the row, so one very common vector, or id, is
many blocks, and queries meet a block at most `QUERIES` at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import ready, renamed, written

SCALE = 256
PIVOTS = 16
ANNULI = 4
SAMPLE = 2000
BLOCK = 8192
QUERIES = 4096
ROWS = 256
EXACT = float(1 << 53)
LONG = float(1 << 63)
OWN = np.iinfo(np.int64).min
BENEATH = OWN + 1


def stacked(blobs: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors of `width` whole components; shorter ones end in zeros."""
    rows = [np.frombuffer(b, np.float64) for b in blobs.to_pylist()]
    if rows and all(len(r) == width for r in rows):
        return np.stack(rows)
    out = np.zeros((len(rows), width))
    for at, row in enumerate(rows):
        out[at, : len(row)] = row
    return out


def lengths_of(a: np.ndarray) -> np.ndarray:
    """The length of each row, also where its square is beyond the range of a float."""
    size = np.abs(a).max(axis=1, initial=0.0)
    return size * np.sqrt(np.square(a / np.where(size > 0, size, 1.0)[:, None]).sum(axis=1))


def wrapped(a: np.ndarray) -> np.ndarray:
    """Whole components modulo 2 ** 64."""
    far = np.abs(a) >= LONG
    out = np.where(far, 0.0, a).astype(np.int64)
    for at in zip(*np.nonzero(far)):
        out[at] = (int(a[at]) + (1 << 63)) % (1 << 64) - (1 << 63)
    return out


def products(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of `a` and `b`, and `OWN` where `own` is set.

    Products of lengths bound every sum: below 2 ** 53 floats are exact.  Beyond that sums
    modulo 2 ** 64 are, if the float sum and its error show that the result is a long;
    where they do not tell, Python integers do.  A result below all longs is `BENEATH`,
    which can rank last only; one above them is an error.
    """
    lengths, others = lengths_of(a), lengths_of(b)
    with np.errstate(over="ignore", invalid="ignore"):
        near = a @ b.T
        if lengths.max(initial=0) * others.max(initial=0) < 0.99 * EXACT:
            return np.where(own, OWN, near.astype(np.int64))
        reach = np.outer(lengths, others)
        exact = np.where(reach < 0.99 * EXACT, near, 0.0).astype(np.int64)
        scores = np.where(reach < 0.99 * EXACT, exact, wrapped(a) @ wrapped(b).T)
        error = reach * (max(a.shape[1], 1) * 2.0**-52)
        sure = (reach < 0.99 * LONG) | (np.abs(near) + error < 0.99 * LONG)
        beneath = near + error < -LONG
        above = near - error >= LONG
    for at in zip(*np.nonzero(~(sure | beneath | above | own))):
        value = sum(int(x) * int(y) for x, y in zip(a[at[0]], b[at[1]]) if x and y)
        above[at], beneath[at] = value >= 1 << 63, value <= BENEATH
        scores[at] = 0 if above[at] or beneath[at] else value
    if (above & ~own & ~sure).any():
        raise ValueError("An inner product exceeds 64 bits.")
    return np.where(own, OWN, np.where(beneath & ~sure, BENEATH, scores))


def quantise(scale: float):
    """Whole components as floats, which hold them exactly; the greatest of them, and the
    squared length in its units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            with np.errstate(over="ignore"):
                whole = np.floor(np.asarray(column.flatten(), dtype=np.float64) * scale) + 0.0
            if not np.isfinite(whole).all():
                raise ValueError("A scaled component is beyond the range of a float.")
            rows = [whole[e - n : e] for n, e in zip(lengths.tolist(), ends.tolist())]
            sizes = np.array([np.abs(r).max(initial=0.0) for r in rows])
            shares = np.array([np.square(r / (s or 1.0)).sum() for r, s in zip(rows, sizes)])
            blobs = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), blobs, pa.array(sizes, pa.float64()), pa.array(shares, pa.float64())],
                ["id", "vec", "size", "share"],
            )

    return run


def lifted(points: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([points, np.sqrt(np.maximum(most - (points**2).sum(axis=1), 0))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def spread_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Points far from one another: each the farthest from those before it."""
    if not len(points):
        return points
    chosen, nearest = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def keyed(shared):
    """Add the nearest pivot of each vector and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, width, most, unit = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            far = distances(lifted(stacked(batch.column("vec"), width) / unit, most), pivots)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("vec"), pa.array(cell.astype(np.int32)),
                    pa.array(far[np.arange(len(cell)), cell]),
                ],
                ["id", "vec", "cell", "far"],
            )

    return run


def visits(shared, later: bool):
    """The annuli of each query: the one its distance falls in, or later those its bound allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, width, most, unit, rings = shared.value
        cells, lows, highs = rings["cell"], rings["low"], rings["high"]
        for batch in batches:
            if not batch.num_rows:
                continue
            points = stacked(batch.column("vec"), width) / unit
            norms = (points**2).sum(axis=1)
            far = distances(np.column_stack([points, np.zeros(len(norms))]), pivots)[:, cells]
            gap = np.maximum(np.maximum(far - highs, lows - far), 0)
            home = np.lexsort((np.broadcast_to(np.arange(len(cells)), gap.shape), np.abs(far), gap), axis=1)[:, 0]
            wanted = np.zeros(gap.shape, dtype=bool)
            if later:
                # Rounding of distances may not lose a vector: bounds get a margin.
                whole = (norms + most)[:, None]
                least = np.maximum(gap - 1e-6 * (far + highs + np.sqrt(whole)), 0)
                reach = (whole - least**2) / 2 + 1e-9 * whole
                known = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                wanted = ~(reach < known[:, None] / unit / unit)
            else:
                wanted[np.arange(len(home)), home] = True
            query, ring = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(query)) for c in ("id", "vec", "least")]
                + [pa.array(ring.astype(np.int32)), pa.array(ring == home[query])],
                ["query_id", "query", "least", "ring", "home"],
            )

    return run


def best_of_block(width: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            ids = left.column("id").to_numpy()
            vectors = stacked(left.column("vec"), width)
            owners = right.column("query_id").to_numpy()
            least = right.column("least").cast(pa.int64()).fill_null(int(BENEATH)).to_numpy()
            queries = stacked(right.column("query"), width)
            for start in range(0, len(owners), ROWS):
                own = owners[start : start + ROWS]
                scores = products(queries[start : start + ROWS], vectors, own[:, None] == ids[None, :])
                floor = least[start : start + ROWS]
                if scores.shape[1] > k:
                    floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
                row, at = np.nonzero((scores >= floor[:, None]) & (scores > OWN))
                value, name = scores[row, at], ids[at]
                order = np.lexsort((name, -value, row))
                row, value, name = row[order], value[order], name[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = place < k
                found.append(np.stack([own[row[kept]], name[kept], value[kept]]))
        rows = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        return pa.table({"query_id": rows[0], "vec_id": rows[1], "score": rows[2]})

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 5,
    scale: float = SCALE,
) -> DataFrame:
    """Per query and rank from 1: `query_id`, `rank`, `vec_id`, `score`.

    `queries` has the columns of `vectors`.  Candidates are all rows of another id; ties
    go to the smaller id.  Rows without id, and vectors that are null or hold null or
    non-finite components, take no part; a shorter vector counts as ending in zeros.  A
    repeated row is a candidate once more under its id.  Finite components of any size take
    part: only a score of the result that is no long is an error, or a component that is
    infinite when scaled.
    """
    spark = ready(vectors.sparkSession)

    def valid(df: DataFrame) -> DataFrame:
        rows = renamed(df, id=id_column, vec=vector_column).where("id IS NOT NULL AND vec IS NOT NULL")
        finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
        rows = rows.where(finite).select(F.col("id").cast("long").alias("id"), "vec")
        return rows.mapInArrow(quantise(scale), "id long, vec binary, size double, share double")

    index = written(valid(vectors), "vectors")
    asked = written(valid(queries).dropDuplicates(["id", "vec"]), "queries")
    figures = (F.max("size").alias("size"), F.max(F.octet_length("vec")).alias("bytes"), F.count(F.lit(1)).alias("n"))
    shape, widest = index.agg(*figures).first(), asked.agg(*figures).first()
    result = "query_id long, vec_id long, score long"
    if not shape["n"] or not widest["n"]:
        empty = spark.createDataFrame([], result)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    width = max(shape["bytes"], widest["bytes"]) // 8
    unit = math.ldexp(1.0, min(max(math.frexp(max(shape["size"], widest["size"]))[1], 0), 1023))
    most = index.agg(F.max(F.col("share") * F.pow(F.col("size") / unit, F.lit(2.0)))).first()[0]
    sample = index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    pivots = spread_pivots(lifted(stacked(sample.column("vec"), width) / unit, most), PIVOTS)
    dealing = F.monotonically_increasing_id().alias("salt")  # fixed once it is written
    found = index.mapInArrow(
        keyed(spark.sparkContext.broadcast((pivots, width, most, unit))), "id long, vec binary, cell int, far double"
    )
    cells = written(found.select("*", dealing), "cells")
    bounds = {r["cell"]: (r["low"], r["high"]) for r in cells.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    lows = F.get(F.array(*[F.lit(float(bounds.get(c, (0, 0))[0])) for c in range(len(pivots))]), F.col("cell"))
    steps = F.get(F.array(*[F.lit(float((bounds.get(c, (0, 0))[1] - bounds.get(c, (0, 0))[0]) / ANNULI or 1)) for c in range(len(pivots))]), F.col("cell"))
    annulus = F.least(F.floor((F.col("far") - lows) / steps), F.lit(ANNULI - 1)).cast("int")
    cells = cells.withColumn("place", F.col("cell") * ANNULI + annulus)
    stats = cells.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    stats = sorted(stats.collect(), key=lambda r: r["place"])  # at most PIVOTS x ANNULI rows
    rings = {
        "cell": np.array([r["place"] // ANNULI for r in stats]),
        "low": np.array([r["low"] for r in stats]),
        "high": np.array([r["high"] for r in stats]),
    }
    ring_of = {r["place"]: i for i, r in enumerate(stats)}
    blocks = F.array(*[F.lit(-(-r["n"] // BLOCK)) for r in stats])
    ring = F.get(F.array(*[F.lit(ring_of.get(p, -1)) for p in range(len(pivots) * ANNULI)]), F.col("place"))
    turns = -(-widest["n"] // QUERIES)
    # The later search goes to every block but the one a query has seen: block 0 of its own
    # annulus.
    dealt = cells.select("id", "vec", "salt", ring.alias("ring")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("salt"), F.get(blocks, F.col("ring"))).cast("int")).drop("salt")
    shared = spark.sparkContext.broadcast((pivots, width, most, unit, rings))
    keys = ["ring", "block", "turn"]

    def search(waiting: DataFrame, later: bool) -> DataFrame:
        sent = waiting.mapInArrow(visits(shared, later), "query_id long, query binary, least long, ring int, home boolean")
        sent = sent.withColumn("turn", F.pmod(F.xxhash64("query_id", "query"), F.lit(turns)).cast("int"))
        if later:
            sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("ring")) - 1)))
            sent = sent.where("NOT (home AND block = 0)")
        else:
            sent = sent.withColumn("block", F.lit(0))
        sent = sent.select("query_id", "query", "least", *keys)
        met = dealt if later else dealt.where("block = 0")
        return met.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(best_of_block(width, k), result)

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = written(search(asked.withColumn("least", F.lit(None).cast("long")), False), "near")
    known = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    known = known.where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
    waiting = asked.join(known, "id", "left")
    found = near.unionByName(search(waiting, True))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    failure = F.raise_error(F.lit("An inner product exceeds 64 bits.")).cast("long")
    score = F.when(F.col("score") > int(BENEATH), F.col("score")).otherwise(failure)
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
