"""Hard negatives against brute force, and the packed products."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import negatives, queries


def brute(rows, scale=256, k=5, n=3):
    def valid(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    def up(x):
        return int(x) * scale if abs(x) > 2**53 else math.floor(x * scale)

    whole = [
        (i, (c + 1) % 10 if i % 7 == 0 else c, [up(x) for x in v])
        for i, c, v in rows if i is not None and c is not None and valid(v)
    ]
    out = set()
    for anchor, label, a in whole:
        if anchor % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v)), i, c) for i, c, v in whole if i != anchor]
        for p, positive in sorted((s, i) for s, i, c in scored if c == label)[:k]:
            hard = sorted((s, i) for s, i, c in scored if c != label and 50 * -p <= 100 * -s <= 95 * -p)[:n]
            out |= {(anchor, positive, at + 1, i, -p, -s) for at, (s, i) in enumerate(hard)}
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, path, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, place int, anchor string")
    frame.repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return queries.op12_hard_negatives(spark, str(path)).select(*COLUMNS).collect()


def vectors(count, size=8.0, width=6, seed=1):
    r = random.Random(seed)
    return [(i, r.randrange(4), [size * (r.random() - 0.3) for _ in range(width)]) for i in range(count)]


@pytest.mark.parametrize("size", [1.0, 1e3, 3e6])
def test_against_brute_force(spark, tmp_path, size):
    rows = vectors(260, size)
    rows += [(300, None, [1.0] * 6), (350, 1, None), (400, 1, [1.0, None]), (450, 1, [float("nan")]), (None, 1, [1.0])]
    rows += [(500, 2, []), (550, 2, [2.0, 2.0]), (600, 1, [float("inf")] * 6), (-50, 3, [size, size, 0.0, 0.0, 0.0, 0.0])]
    got = mined(spark, tmp_path, rows)
    assert len(got) > 20 and sorted(map(tuple, got)) == brute(rows)


def test_ties_and_blocks(spark, tmp_path, monkeypatch):
    rows = [(i, i % 3, [float(i % 4), 1.0]) for i in range(200)]
    monkeypatch.setattr(negatives, "MOST_ROWS", 16)
    monkeypatch.setattr(negatives, "ROWS", 16)
    got = mined(spark, tmp_path, rows)
    assert sorted(map(tuple, got)) == brute(rows)


def test_a_large_component_among_small_ones(spark, tmp_path):
    rows = vectors(120, 1.0) + [(1001, 2, [1e14, 0.0, 0.0, 0.0, 0.0, 0.0])]
    assert sorted(map(tuple, mined(spark, tmp_path, rows))) == brute(rows)


def test_scores_beyond_a_long_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="exceeds 64 bits"):
        mined(spark, tmp_path, [(0, 1, [1e300]), (50, 1, [1e300]), (1, 2, [1.0])])


def test_repeated_rows_are_candidates_once_more_and_one_anchor(spark, tmp_path):
    rows = [(50, 1, [1.0])] * 2 + [(1, 1, [4.0])] * 2 + [(2, 2, [3.0])] * 2
    got = sorted(map(tuple, mined(spark, tmp_path, rows)))
    assert got == [(50, 1, r, 2, 256 * 1024, 256 * 768) for r in (1, 1, 2, 2)]


def test_empty(spark, tmp_path):
    assert mined(spark, tmp_path, []) == []


def test_oracle(spark, tmp_path):
    rows = vectors(300, 1.0)
    got = mined(spark, tmp_path, rows)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = connection.execute(queries.OP12_SQL).fetchall()
    assert len(want) > 20 and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("width,a,b", [(64, 150, 150), (4, 3, 900), (64, 1 << 22, 1 << 22), (1, 1, 1)])
def test_packed_fields_hold_exact_sums(width, a, b):
    r = np.random.default_rng(width)
    x = r.integers(-a, a + 1, (7, width)).astype(float)
    y = r.integers(-b, b + 1, (23, width)).astype(float)
    x[0], y[0], y[1] = a, b, -b
    want = x.astype(np.int64) @ y.astype(np.int64).T
    assert (negatives.packed_scores(x, y, a, b) == want).all()
    assert negatives.wide_scores(x.astype(int).tolist(), y.astype(int).tolist()) == want.tolist()


def test_other_labels_and_names(spark):
    rows = [("a", i, [float(i), 1.0]) if i % 2 else ("b", i, [float(i), 2.0]) for i in range(1, 9)]
    frame = spark.createDataFrame(rows, "kind string, key long, v array<float>")
    got = negatives.mine(frame, F.col("key") == 1, "key", "kind", "v", positives=1, negatives=2, low=0, high=100, scale=1)
    assert [tuple(x) for x in got.select(*COLUMNS).orderBy("rank").collect()] == [(1, 7, 1, 6, 8, 8), (1, 7, 2, 4, 8, 6)]
