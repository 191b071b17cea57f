"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import queries, runs


def brute(words, least=6, copies=4):
    n, found = len(words), {}
    for period in range(1, n // copies + 1):
        at = 0
        while at < n - period:
            start = at
            while at < n - period and words[at] == words[at + period]:
                at += 1
            stop = at + period
            if at > start and stop - start >= max(least, copies * period):
                found.setdefault((start, stop), period)
            at += at == start
    return sorted((start, stop - start, period) for (start, stop), period in found.items())


@pytest.mark.parametrize("least,copies", [(6, 4), (2, 2), (1, 3), (20, 2)])
def test_runs_of_random_words(least, copies):
    for seed in range(400):
        r = random.Random(seed)
        words = [r.randrange(1 + seed % 4) for _ in range(r.randrange(50))]
        unit = [r.randrange(6) for _ in range(r.randrange(1, 9))]
        words += unit * r.randrange(2, 7) + unit[: r.randrange(len(unit))] + words[: r.randrange(len(words) + 1)]
        got = runs.runs_of(np.array(words, dtype=np.uint64), least, copies)
        assert got == brute(words, least, copies), words


def test_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    words = np.array(b, dtype=np.uint64)
    assert runs.runs_of(words, 2, 2) == brute(b, 2, 2)
    assert runs.runs_of(np.zeros(5000, dtype=np.uint64)) == [(0, 5000, 1)]
    assert runs.runs_of(np.zeros(5, dtype=np.uint64)) == []


def test_stretches_pass_over_prose_and_hold_every_run():
    r = random.Random(3)
    prose = [r.randrange(100_000) for _ in range(3000)]
    words = np.array(prose + [1, 2, 3] * 5 + prose[:200], dtype=np.uint64)
    (low, high), *rest = runs.stretches(words, 6, 4)
    assert not rest and low <= 3000 and high >= 3015 and high - low < 60


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found, kept = brute(words), [True] * n
    for start, length, period in found:
        kept[start + period : start + length] = [False] * (length - period)
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if found else (None, None, None)
    lines = "".join("%d,%d,%d\n" % x for x in found)
    rest = " ".join(w for w, k in zip(words, kept) if k)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)]
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *sha)


def test_query(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("ab cd é f\tg  h".split(" ")) for _ in range(r.randrange(60)))) for i in range(150)]
    rows += [(1000 + i, " ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(400)))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (None, "x x x x x x x"), (None, None), (7, "a a a a a a b")] * 2
    rows += [(3000, "p q r " * 40_000 + "s")]
    frame = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, runs int, id string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    want = [expected(*x) for x in rows[:-1]]
    assert sorted(map(repr, map(tuple, (x for x in got if x.doc_id != 3000)))) == sorted(map(repr, want))
    (long,) = [x for x in got if x.doc_id == 3000]
    assert zlib.crc32(b"3000") % 10 == 0 or (long.n_runs, long.start, long.length, long.period) == (1, 0, 120_000, 3)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_periodic_runs(spark, str(tmp_path)).count() == 0


def test_operator_returns_texts_and_runs(spark):
    docs = spark.createDataFrame([("k", "go " * 7 + "on", 3)], "name string, body string, text int")
    (row,) = runs.collapse_runs(docs, "name", "body").collect()
    assert (row.id, row.n_words, row.text) == ("k", 8, "go on")
    assert [tuple(x) for x in row.runs] == [(0, 7, 1)]
