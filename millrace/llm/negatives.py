"""Hard negatives by exact integer scores from Kronecker-packed products.

Components become integers floor(scale * x).  Several candidates' components, biased to be
at least 0, are put into separated bit fields of one wide integer; one multiplication by an
anchor's biased component then multiplies them all, and the sums over the components keep
to their fields, from which the exact scores are unpacked.  The wide integers are the 53
bits a double holds exactly, so the sums are one matrix product, where two or more fields
fit (or one); rows of larger components use Python integers of `WIDE` fields of any width.

Anchors meet candidates in blocks, twice: first those of their own label, which gives the
positives, then all others with the positives' score ranges.  A block's best rows per anchor
are ranked after it.  Blocks are cut by a hash of the row, so a hot label or a very common
vector is many blocks.  Nothing is approximate and no candidate is left out.

Rows without id, label or vector, and vectors with a null or non-finite component, take no
part; a shorter vector counts as ending in zeros, an empty one as all zeros.  Ties go to the
smaller id; a repeated row is a candidate once more, but one anchor.  Rows of the anchor's
own id are neither its positives nor its negatives.  Scores must fit a long: one that does
not, of any anchor and candidate, is an error.  Empty tables give no rows.  Columns other
than the three named do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..table import col
from .frames import ready, renamed, written

SCALE = 256
BLOCK_BYTES = 8 << 20
MOST_ROWS = 1 << 14
ROWS = 256
WIDE = 32
BITS = 53


def whole(blobs: pa.ChunkedArray | pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Components floor(scale * x): as doubles, and whether each row has one no double can scale."""
    vectors = np.zeros((len(blobs), width))
    for at, blob in enumerate(blobs.to_pylist()):
        row = np.frombuffer(blob, np.float64)
        vectors[at, : len(row)] = row
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    beyond = ~np.isfinite(scaled).all(axis=1)
    scaled[beyond] = vectors[beyond]
    return scaled, beyond


def field_bits(width: int, a: int, b: int) -> int:
    """Bits that hold every sum of `width` products of biased components up to 2a and 2b."""
    return max(1, (width * 2 * a * 2 * b).bit_length())


def packed_scores(anchors: np.ndarray, others: np.ndarray, a: int, b: int) -> np.ndarray:
    """Scores from doubles as wide integers; components are up to a and b in size."""
    width = anchors.shape[1]
    bits = field_bits(width, a, b)
    fields = BITS // bits
    rows = -(-len(others) // fields)
    biased = np.zeros((rows * fields, width))
    biased[: len(others)] = others + b
    weights = np.ldexp(1.0, bits * np.arange(fields))
    wide = (biased.reshape(rows, fields, width) * weights[None, :, None]).sum(axis=1)
    sums = ((anchors + a) @ wide.T).astype(np.int64)
    out = np.empty((len(anchors), rows, fields), dtype=np.int64)
    for field in range(fields):
        out[:, :, field] = (sums >> (bits * field)) & ((1 << bits) - 1)
    out = out.reshape(len(anchors), rows * fields)[:, : len(others)]
    out -= (b * anchors.sum(axis=1).astype(np.int64) + width * a * b)[:, None]
    out -= (a * others.sum(axis=1).astype(np.int64))[None, :]
    return out


def wide_scores(anchors: list[list[int]], others: list[list[int]]) -> list[list[int]]:
    """Scores from Python integers as wide integers, for components of any size."""
    width = len(anchors[0])
    a = max((abs(x) for row in anchors for x in row), default=0)
    b = max((abs(x) for row in others for x in row), default=0)
    bits = field_bits(width, a, b)
    mask = (1 << bits) - 1
    out: list[list[int]] = [[] for _ in anchors]
    own = [b * sum(row) + width * a * b for row in anchors]
    for start in range(0, len(others), WIDE):
        part = others[start : start + WIDE]
        wide = [sum((row[j] + b) << (bits * t) for t, row in enumerate(part)) for j in range(width)]
        theirs = [a * sum(row) for row in part]
        for at, anchor in enumerate(anchors):
            total = sum((x + a) * w for x, w in zip(anchor, wide))
            out[at] += [((total >> (bits * t)) & mask) - own[at] - theirs[t] for t in range(len(part))]
    return out


def as_integers(vectors: np.ndarray, beyond: np.ndarray, scale: int) -> list[list[int]]:
    return [[int(x) * (scale if far else 1) for x in row] for row, far in zip(vectors.tolist(), beyond.tolist())]


def all_scores(
    anchors: np.ndarray, far_anchors: np.ndarray, others: np.ndarray, far_others: np.ndarray, scale: int
) -> np.ndarray:
    """Exact inner products of all rows of the two, in longs."""
    width = max(anchors.shape[1], 1)
    out = np.zeros((len(anchors), len(others)), dtype=np.int64)
    if not out.size or not anchors.shape[1]:
        return out
    # Rows whose components let one field fit a double whatever row of this kind they meet.
    most = int(np.sqrt(float(1 << (BITS - 2)) / (4 * width)))
    kinds = []
    for vectors, far in ((anchors, far_anchors), (others, far_others)):
        size = np.abs(vectors).max(axis=1)
        plain = (size <= most) & ~far
        kinds.append((np.flatnonzero(plain), np.flatnonzero(~plain), int(size[plain].max(initial=0))))
    (small_a, large_a, a), (small_b, large_b, b) = kinds
    if len(small_a) and len(small_b):
        out[np.ix_(small_a, small_b)] = packed_scores(anchors[small_a], others[small_b], max(a, 1), max(b, 1))
    for some, rest in ((large_a, np.arange(len(others))), (small_a, large_b)):
        if not len(some) or not len(rest):
            continue
        exact = wide_scores(
            as_integers(anchors[some], far_anchors[some], scale), as_integers(others[rest], far_others[rest], scale)
        )
        try:
            out[np.ix_(some, rest)] = np.array(exact, dtype=np.int64)
        except OverflowError:
            raise ValueError("An inner product exceeds 64 bits.") from None
    return out


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of each row's k highest allowed scores, ties to smaller ids; ids ascend."""
    lowest = np.iinfo(np.int64).min
    values = np.where(allowed, scores, lowest)
    floor = np.full(len(values), lowest)
    if values.shape[1] > k:
        floor = np.partition(values, -k, axis=1)[:, -k]
    row, at = np.nonzero(allowed & (values >= floor[:, None]))
    order = np.lexsort((at, ~values[row, at], row))
    row, at = row[order], at[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], at[kept]


def by_id(table: pa.Table) -> pa.Table:
    return table.sort_by("id") if table.num_rows else table


def positives_of_block(width: int, scale: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros((3, 0), dtype=np.int64)]
        if left.num_rows and right.num_rows:
            left = by_id(left)
            ids = left.column("id").to_numpy()
            others, far_others = whole(left.column("vec"), width, scale)
            owners, keys = right.column("id").to_numpy(), right.column("anchor").to_numpy()
            anchors, far = whole(right.column("vec"), width, scale)
            for start in range(0, len(owners), ROWS):
                part = slice(start, start + ROWS)
                scores = all_scores(anchors[part], far[part], others, far_others, scale)
                row, at = best(scores, owners[part][:, None] != ids[None, :], ids, k)
                found.append(np.stack([keys[part][row], ids[at], scores[row, at]]))
        rows = np.concatenate(found, axis=1)
        return pa.table({"anchor": rows[0], "positive_id": rows[1], "positive_score": rows[2]})

    return run


def negatives_of_block(width: int, scale: int, k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros((5, 0), dtype=np.int64)]
        if left.num_rows and right.num_rows:
            left = by_id(left)
            ids, labels = left.column("id").to_numpy(), np.array(left.column("label").to_pylist(), dtype=object)
            others, far_others = whole(left.column("vec"), width, scale)
            owners, keys = right.column("id").to_numpy(), right.column("anchor").to_numpy()
            own = np.array(right.column("label").to_pylist(), dtype=object)
            _, codes = np.unique(np.concatenate([labels, own]), return_inverse=True)
            labels, own = codes[: len(labels)], codes[len(labels) :]
            positives = right.column("positives").to_pylist()
            anchors, far = whole(right.column("vec"), width, scale)
            for start in range(0, len(owners), ROWS):
                part = slice(start, start + ROWS)
                scores = all_scores(anchors[part], far[part], others, far_others, scale)
                other = (own[part][:, None] != labels[None, :]) & (owners[part][:, None] != ids[None, :])
                asked = positives[part]
                for slot in range(max(map(len, asked))):
                    has = np.flatnonzero([len(p) > slot for p in asked])
                    mine = [asked[i][slot] for i in has]
                    # low * positive <= 100 * score <= high * positive, in integers.
                    least = np.array([-(-low * p["positive_score"] // 100) for p in mine])[:, None]
                    most = np.array([high * p["positive_score"] // 100 for p in mine])[:, None]
                    fits = scores[has]
                    row, at = best(fits, other[has] & (fits >= least) & (fits <= most), ids, k)
                    which = has[row]
                    found.append(
                        np.stack(
                            [
                                keys[part][which],
                                np.array([p["positive_id"] for p in mine])[row],
                                np.full(len(row), slot),
                                ids[at],
                                fits[row, at],
                            ]
                        )
                    )
        rows = np.concatenate(found, axis=1)
        names = ["anchor", "positive_id", "slot", "negative_id", "negative_score"]
        return pa.table(dict(zip(names, rows)))

    return run


def doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their doubles."""
    for batch in batches:
        column = batch.column("vec")
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        flat = np.asarray(column.flatten(), dtype=np.float64)
        starts = np.concatenate([[0], ends[:-1]])
        rows = [flat[b:e].tobytes() for b, e in zip(starts.tolist(), ends.tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), batch.column("asked"), pa.array(rows, pa.binary())],
            ["id", "label", "asked", "vec"],
        )


def mine(
    vectors: DataFrame,
    anchors: Column,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = SCALE,
) -> DataFrame:
    """Per anchor, positive and rank: `anchor_id`, `positive_id`, `rank`, `negative_id` and scores.

    `anchors` is a condition on the columns of `vectors`.  An anchor's positives are its
    `positives` best other rows of its label; a positive's negatives its `negatives` best
    rows of another label that score between `low` and `high` percent of it.
    """
    spark = ready(vectors.sparkSession)
    rows = vectors.select(
        col(id_column).cast("long").alias("id"), col(label_column).alias("label"),
        col(vector_column).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asked"),
    )
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))))
    kind = rows.schema["label"].dataType.simpleString()
    rows = rows.select("id", "label", "asked", "vec")
    rows = rows.mapInArrow(doubles, f"id long, label {kind}, asked boolean, vec binary")
    # The number of a row is settled by the write; it deals repeated rows to different blocks.
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "labelled")
    shape = rows.agg(
        F.max(F.octet_length("vec")).alias("bytes"), F.count(F.lit(1)).alias("n"),
        F.count_if("asked").alias("anchors"),
    ).first()
    width = (shape["bytes"] or 0) // 8
    block = max(ROWS, min(MOST_ROWS, BLOCK_BYTES // (8 * max(width, 1))))
    blocks, turns = (max(1, -(-shape[c] // block)) for c in ("n", "anchors"))
    asked = rows.where("asked").withColumn("anchor", F.xxhash64("id", "label", "vec"))
    asked = asked.dropDuplicates(["id", "label", "vec"]).select("anchor", "id", "label", "vec")
    asked = written(asked.withColumn("turn", F.pmod(F.xxhash64("anchor"), F.lit(turns)).cast("int")), "anchors")

    def every(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    hashed = F.xxhash64("place")
    # Positives: anchors meet the blocks of their label only.
    sizes = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("cuts"))
    kin = rows.join(sizes, "label").withColumn("block", F.pmod(hashed, F.col("cuts")).cast("int"))
    kin = kin.withColumn("turn", every(F.lit(turns))).select("id", "vec", "label", "block", "turn")
    sent = asked.join(sizes, "label").withColumn("block", every(F.col("cuts")))
    keys = ["label", "block", "turn"]
    near = kin.groupBy(*keys).cogroup(sent.select("anchor", "id", "vec", *keys).groupBy(*keys)).applyInArrow(
        positives_of_block(width, scale, positives), "anchor long, positive_id long, positive_score long"
    )
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = near.groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives")
    )
    asked = written(asked.join(near, "anchor"), "positives")
    # Negatives: anchors, with their positives' scores, meet all blocks.
    others = rows.withColumn("block", F.pmod(hashed, F.lit(blocks)).cast("int"))
    others = others.withColumn("turn", every(F.lit(turns))).select("id", "label", "vec", "block", "turn")
    sent = asked.withColumn("block", every(F.lit(blocks)))
    found = others.groupBy("block", "turn").cogroup(sent.groupBy("block", "turn")).applyInArrow(
        negatives_of_block(width, scale, negatives, low, high),
        "anchor long, positive_id long, slot long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    scored = asked.select(
        "anchor", F.col("id").alias("anchor_id"),
        F.posexplode("positives").alias("slot", "positive"),
    )
    return found.join(scored.withColumn("slot", F.col("slot").cast("long")), ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", "negative_id",
        F.col("positive.positive_score").alias("positive_score"), "negative_score",
    )
