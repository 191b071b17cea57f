"""WARC archives and exact top-k search."""

import base64
import gzip
import hashlib
import io
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, topk, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


PAGES = [(i, f"http://h{i % 4}.example/{i}", f"<p>é page {i % 11}\r\n\r\nWARC/1.1\r\n</p>") for i in range(60)] + [
    (100, None, None), (101, "http://x/\r\nWARC-Type: evil", ""), (102, "u", "y" * 3_000_000), (None, "u", "alone"),
    (None, "u", "<p>é page 1\r\n\r\nWARC/1.1\r\n</p>"), (5, "u", "twice"), (5, "u", "twice"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    pages(spark, PAGES).withColumn("digest", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op7_warc(spark, str(tmp_path)).collect()
    first = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    want = []
    for page_id, _, html in PAGES:
        html = html or ""
        origin = first.get(html)
        response = origin is None or page_id == origin
        want.append((page_id, len(html.encode()), digest(html), "response" if response else "revisit", None if response else origin))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_oracle_agrees(spark, tmp_path):
    rows = [r for r in PAGES if r[0] is not None]
    pages(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = connection.execute(queries.OP7_SQL).fetchall()
    got = queries.op7_warc(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_filters_are_pushed_and_payloads_skipped(spark, tmp_path):
    path = f"{tmp_path}/warc"
    warc.write_archives(pages(spark, PAGES), path, least_revisit=1)
    found = warc.read_archives(spark, path, ["record_type", "target_uri"]).where("record_type = 'revisit'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter")[-1] or "Filter" not in plan
    assert {r.record_type for r in found.collect()} == {"revisit"}
    some = warc.read_archives(spark, path).where(F.col("record_type").isin("response") & F.col("refers_to").isNull())
    assert some.where("target_uri = 'u' AND octet_length(payload) = 3000000").count() == 1
    empty = warc.read_archives(spark, path).where("octet_length(payload) = 0 AND record_type = 'response'")
    assert empty.count() == 2  # below the least size even equal payloads are responses
    warc.write_archives(pages(spark, []), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def test_blocks_are_read_on_demand():
    text = b"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nWARC-Type: b\r\nContent-Length: 2\r\n\r\nxy\r\n\r\n"
    for stream in (warc.Buffered(io.BytesIO(text)), gzip.GzipFile(fileobj=warc.Buffered(io.BytesIO(gzip.compress(text[:55]) + gzip.compress(text[55:]))))):
        seen = [(h["warc-type"], b.read() if h["warc-type"] == "b" else None) for h, b in warc.records(stream)]
        assert seen == [("a", None), ("b", b"xy")]
    for broken in (text[:-6], b"nonsense\r\n", b"WARC/1.1\r\nno colon\r\n\r\n"):
        with pytest.raises((EOFError, ValueError)):
            [b.read() for _, b in warc.records(warc.Buffered(io.BytesIO(broken)))]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, every, k=5, scale=256):
    whole = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v, _ in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in whole:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return sorted(out)


def search(df, every, **options):
    return sorted(map(tuple, topk.top_k(df, df.where(f"vec_id % {every} = 0"), **options).collect()))


@pytest.mark.parametrize("block", [topk.BLOCK, 7])
def test_top_k_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 9 if block == 7 else topk.QUERIES)
    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=6).tolist(), 0) for i in range(300)]
    rows += [(300 + i, [1.0, 0.5, 0.0, -1.0, 0.25, 0.0], 1) for i in range(120)]
    rows += [(1000, None, 0), (1001, [None] * 6, 0), (1002, [float("nan")] + [0.0] * 5, 0), (1003, [float("inf")] * 6, 0),
             (1004, [0.0] * 6, None), (1005, [2.0, 1.0], 0), (None, [1.0] * 6, 0), (1006, [], 0), (1010, [-3.0] * 6, 0)]
    df = vectors(spark, rows).withColumn("id", F.lit(1)).repartition(4)
    assert search(df, 10) == brute(rows, 10)


def test_repeated_and_few_rows(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (1, [0.5, 0.5], 0)]
    got = search(vectors(spark, rows), 2)
    assert got == [(0, 1, 1, 128 * 256), (0, 2, 1, 128 * 256)]
    assert search(vectors(spark, rows[:1]), 2) == []
    assert search(vectors(spark, []), 2) == []
    assert search(vectors(spark, [(1, [1.0], 0), (3, [2.0], 0)]), 2) == []


def test_large_components_stay_exact(spark):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(size=4) * 1e5).tolist(), 0) for i in range(60)]
    assert search(vectors(spark, rows), 6) == brute(rows, 6)


def test_far_annuli_are_not_visited():
    """A bound that cannot reach the known score keeps a query away."""

    class Shared:
        value = (np.array([[0.0, 0.0, 0.0]]), 2, 100.0, 1.0, {"cell": np.array([0, 0]), "low": np.array([0.0, 9.0]), "high": np.array([1.0, 10.0])})

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([np.array([10.0, 0.0]).tobytes()]), pa.array([99])], ["id", "vec", "least"]
    )
    rings = [b.column("ring").to_pylist() for b in topk.visits(Shared, True)(iter([batch]))]
    assert rings == [[1]]


@pytest.mark.parametrize("large", [1e6, 5e6, 1e9, 1e17, 1e300])
def test_large_finite_components_take_part(spark, large):
    """Rows of large components, of scores that fit a long or are far below it."""
    draw = np.random.default_rng(3)
    fits = min(large, 2.0**20)
    rows = [(i, [float(-abs(x)) for x in draw.normal(size=2)] + (draw.normal(size=2) * fits).tolist()) for i in range(60)]
    rows += [(100 + i, [large * (i + 1), 0.0, 1.0, 0.0]) for i in range(1, 3)]
    rows += [(199, [large, large, *(draw.normal(size=2) * 9).tolist()]), (200, [0.0, -0.0, 3.0, -1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(x * 256) for x in v] for i, v in rows}
    want = []
    for i in sorted(i for i in whole if i % 20 == 0 and i != 100):
        scored = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i)
        want += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:5])]
    got = topk.top_k(df, df.where("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("large, score", [(1e9, 256e9 * 512 + 256 * 256), (1e17, None), (-1e17, None), (1e300, None)])
def test_only_a_result_beyond_a_long_is_an_error(spark, large, score):
    vectors = spark.createDataFrame([(0, [large, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 0.5])], "vec_id long, embedding array<double>")
    found = topk.top_k(vectors, vectors.where("vec_id = 0"))
    if score is None:
        with pytest.raises(Exception, match="exceeds 64 bits"):
            found.collect()
    else:
        assert found.where("rank = 1").first()["score"] == score


def test_products_are_exact_at_every_size():
    draw = np.random.default_rng(6)
    for _ in range(200):
        a, b = (np.floor(draw.normal(size=(5, 3)) * 2.0 ** draw.integers(0, 45, size=(5, 1))) for _ in range(2))
        a[0] = np.floor(draw.normal(size=3) * 2.0**70) * (draw.random(3) < 0.5)
        own = draw.random((5, 5)) < 0.1
        want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
        if any(v >= 1 << 63 and not own[i, j] for i, r in enumerate(want) for j, v in enumerate(r)):
            with pytest.raises(ValueError):
                topk.products(a, b, own)
            continue
        got = topk.products(a, b, own)
        for i, r in enumerate(want):
            for j, v in enumerate(r):
                assert got[i, j] == (topk.OWN if own[i, j] else max(v, topk.BENEATH))


def test_the_first_search_meets_one_block_a_ring(spark, monkeypatch):
    """Rows of one id and one vector are dealt to many blocks, and the first search sees the first only."""
    sizes = []
    monkeypatch.setattr(topk, "BLOCK", 50)
    rows = [(7, [1.0, 2.0])] * 600 + [(i, [float(i), 1.0]) for i in range(10, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    real = topk.written

    def written(frame, name):
        out = real(frame, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(topk, "written", written)
    got = topk.top_k(df, df.where("vec_id = 10")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [19, 18, 17, 16, 15]
    assert dict(sizes)["vectors"] == 610 and dict(sizes)["near"] <= 5
