"""Line dedup, n-gram join, substring dedup and fingerprints against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import fingerprints, line_dedup, ngram_join, queries, substring_dedup
from millrace.llm.following import with_next_text
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], SCHEMA)


def stored(spark, tmp_path, rows, parts=3):
    documents(spark, rows).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def prose(seed, count, words=("the", "of", "And", "x1", "é", "long-word", "b")):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) + str(draw.randint(0, 60)) for _ in range(count))


def edited(text, seed, edits):
    draw, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    base, passage = [prose(i, 120 + 30 * i) for i in range(6)], prose(77, 60)
    rows = [(i, b, f"src{i % 3}") for i, b in enumerate(base)]
    rows += [(100 + i, edited(base[i % 6], i, i % 9), "src0") for i in range(60)]
    rows += [(200 + i, prose(500 + i, 40) + " " + passage + "\n" + prose(900 + i, 20), None) for i in range(10)]
    rows += [(300, None, "src1"), (301, "", None), (302, "  \t", "src2"), (303, "one", "src1"), (304, "One", "src1"),
             (305, "two words", "src2"), (306, "two  words", "src2"), (None, base[0], "src9"), (307, base[1], None),
             (307, base[1], None), (308, prose(5, 4000), "src3"), (309, "a a a a a a a a", "src4")]
    return rows


# line dedup


def test_line_dedup_matches_its_sql(spark, tmp_path):
    rows = [(i, f"unique {i}\nfooter\n\n menu {'x' if i % 9 else 'y'} ", "hot" if i % 3 else None) for i in range(90)]
    rows += [(90, None, "hot"), (91, "", "cold"), (92, "footer", "cold"), (None, "footer\nfooter", "hot"), (93, "a", "hot"), (93, "a", "hot")]
    folder = stored(spark, tmp_path, rows)
    got = queries.op1_line_dedup(spark, folder).collect()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = connection.execute(queries.OP1_SQL).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].text == "unique 1\n" or by_id[1].n_dropped == 2
    assert by_id[92].text == "footer" and by_id[90].text is None and by_id[90].n_lines == 0


def test_line_dedup_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", "s", "mine", 7)], "doc_id long, text string, source string, host string, n_lines int")
    row = line_dedup.drop_boilerplate(df).first()
    assert (row.host, row.n_lines, row.n_dropped, row.text) == ("mine", 2, 0, "a\nb")
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


# n-gram join


def test_line_dedup_empties_a_text_copied_above_the_ratio(spark):
    rows = [(i, "one\ntwo", "s") for i in range(3)] + [(10 + i, f"own {i}", "s") for i in range(20)]
    rows += [(50 + i, "three\nfour", "t") for i in range(2)]
    found = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_boilerplate(documents(spark, rows)).collect()}
    want = {i: ("", 2) for i in range(3)} | {10 + i: (f"own {i}", 0) for i in range(20)}
    assert found == want | {50: ("three\nfour", 0), 51: ("three\nfour", 0)}


def shingles(text, words=3):
    found = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def joined(rows, percent):
    sets = [shingles(t) for _, t, _ in rows]
    links = [[j for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)]
             for i, a in enumerate(sets)]
    seen, out = {}, []
    for i in range(len(rows)):
        if i in seen:
            continue
        members, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in members:
                    members.add(j)
                    todo.append(j)
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        for m in members:
            seen[m] = min(ids) if ids else None
    return sorted(repr((r[0], len(sets[i]), seen[i], len(links[i]))) for i, r in enumerate(rows))


@pytest.mark.parametrize("unit", [ngram_join.UNIT_TOKENS, 300])
def test_ngram_join_matches_brute_force(spark, corpus, unit):
    found = ngram_join.near_copies(documents(spark, corpus).repartition(5), unit_tokens=unit)
    got = sorted(repr((r.id, r.n_shingles, r.component_id, r.n_links)) for r in found.collect())
    assert got == joined(corpus, 90)


def test_ngram_join_at_the_threshold(spark):
    # Sets of ten shingles of one shared ancestor: some share nine of eleven, some nine of ten.
    base = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(base), ""), (2, " ".join(base[:-1]), ""), (3, " ".join([*base[:-1], "z"]), ""), (4, " ".join(base + ["q"]), "")]
    rows += [(10 + n, " ".join(f"v{i}" for i in range(n)), "") for n in range(1, 60)]
    got = sorted(repr((r.id, r.n_shingles, r.component_id, r.n_links)) for r in ngram_join.near_copies(documents(spark, rows)).collect())
    assert got == joined(rows, 90)


@pytest.mark.parametrize("percent", [90, 80])
def test_part_keys_lose_no_link(percent):
    draw = random.Random(11)
    for size in [*range(1, 70, 3), 200, 577, 578, 900]:
        base = [f"w{draw.random()}" for _ in range(size + 2)]
        other = list(base)
        texts = [" ".join(base)]
        for _ in range(40):
            at = draw.randrange(len(other))
            other = other[:at] + other[at + 1 :] if draw.random() < 0.5 and len(other) > 3 else other[:at] + [f"n{draw.random()}"] + other[at + 1 :]
            texts.append(" ".join(other))
        sets = ngram_join.Sets(pa.array(texts), 3)
        keys, owner = sets.keys(percent)
        names = sets.ids()
        own = [set(keys[owner == i].tolist()) for i in range(len(texts))]
        members = [set(sets.values[sets.first[i] : sets.first[i + 1]].tolist()) for i in range(len(texts))]
        for i in range(len(texts)):
            for j in range(i):
                if 100 * len(members[i] & members[j]) >= percent * len(members[i] | members[j]):
                    assert names[i] == names[j] or own[i] & own[j]


@pytest.mark.parametrize("percent", [90, 80])
def test_outlines_lose_no_copy_with_words_appended(percent):
    """Pairs exactly at the limit, on both sides of the sizes where outlines get wider."""
    draw = random.Random(5)
    for size in [64 << k for k in range(9)]:
        for low in (size, size - 1, size * percent // 100 + 1):
            high = low * 100 // percent
            for _ in range(2 if size > 2000 else 12):
                words = [f"w{draw.random()}" for _ in range(high + 2)]
                sets = ngram_join.Sets(pa.array([" ".join(words[: low + 2]), " ".join(words)]), 3)
                a, b = (set(sets.values[sets.first[i] : sets.first[i + 1]].tolist()) for i in (0, 1))
                assert len(a) == low and len(b) == high and 100 * len(a & b) >= percent * len(a | b)
                rows = [ngram_join.outline_counts(x) for x in sets.outlines().to_pylist()]
                assert ngram_join.alike_outlines(sets.sizes, rows, None, percent).tolist() == [0, 0], (low, high)


@pytest.mark.parametrize("cross", [False, True])
def test_outlines_connect_what_all_pairs_connect(cross):
    draw = random.Random(9)
    texts = []
    for size in (5, 12, 60, 70, 130, 140):
        base = [f"w{draw.random()}" for _ in range(size)]
        texts += [" ".join(w if draw.random() < 0.97 else f"n{draw.random()}" for w in base) for _ in range(12)]
    sets = ngram_join.Sets(pa.array(sorted(texts, key=lambda x: x.count(" "))), 3)
    rows = [ngram_join.outline_counts(x) for x in sets.outlines().to_pylist()]
    order = np.argsort(sets.sizes, kind="stable")
    sizes, rows = sets.sizes[order], [rows[i] for i in order]
    sides = np.array([draw.randrange(2) for _ in rows]) if cross else None
    label = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if (cross and sides[i] == sides[j]) or sizes[j] > sizes[i] * 100 // 80:
                continue
            pair = np.array([sizes[i], sizes[j]])
            if ngram_join.alike_outlines(pair, [rows[i], rows[j]], None, 80).tolist() == [0, 0]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert ngram_join.alike_outlines(sizes, rows, sides, 80).tolist() == label
    assert 3 < len(set(label)) < len(label) - 20


def in_one_task(run, batches):
    """What a function of Arrow batches gives for rows of all tasks, sorted by `to`."""
    table = pa.Table.from_batches(batches).sort_by("to")
    return [r for batch in run(iter(table.to_batches())) for r in batch.to_pylist()]


@pytest.mark.parametrize("ranges", [64, 2000])
def test_rows_of_keys_do_not_grow_with_the_keys_of_a_set(ranges):
    """A slice sends a row a range and kind at most, and the keys of several sets come back."""
    draw = random.Random(3)
    base = [[f"w{draw.random()}" for _ in range(400)] for _ in range(40)]
    copies = [b[:at] + ["z"] + b[at:] for b in base for at in (100, 200, 300)]
    texts = [" ".join(x) for x in base + copies]
    slices = [pa.RecordBatch.from_arrays([pa.array(texts[i::3])], ["text"]) for i in range(3)]
    sent = [b for x in slices for b in ngram_join.candidate_rows(5, 80, ranges)(iter([x]))]
    assert len(sent) == 3 and all(b.num_rows <= 3 * ranges for b in sent)
    sets = ngram_join.Sets(pa.array(texts), 5)
    keys, owner = sets.keys(80)
    having = {}
    for key, i in zip(keys.tolist(), owner.tolist()):
        having.setdefault(key, set()).add(int(sets.ids()[i]))
    want = sorted(sorted(x) for x in having.values() if len(x) > 1)
    got = {}
    for row in in_one_task(ngram_join.shared_keys, sent):
        got.setdefault(row["key"], set()).add(row["set"])
    assert sorted(sorted(x) for x in got.values()) == want and len(want) > 1000


def test_a_common_line_makes_no_candidates():
    """Texts of all sizes that have one line in common, and little else."""
    draw = random.Random(8)
    line = " ".join(f"line{i}" for i in range(9))
    texts = [" ".join([line, *(f"w{draw.random()}" for _ in range(size))]) for size in range(50, 1500, 5)]
    sets = ngram_join.Sets(pa.array(texts), 5)
    keys, owner = sets.keys(80)
    pairs = np.unique(np.stack([keys, owner.astype(np.uint64)]), axis=1)
    _, m = np.unique(pairs[0], return_counts=True)
    # Single shingles of the line as keys would be 383 here, and grow with the texts.
    assert m[m > 1].sum() < 100


def test_sparse_parts_use_prefixes():
    """Sets whose hashes leave parts empty are still candidates of one another."""
    sets = ngram_join.Sets(pa.array(["x"]), 3)
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 40, 21, dtype=np.uint64))
    sets.values = np.concatenate([values[:-1], values[1:]])
    sets.text = np.repeat([0, 1], 20)
    sets.sizes, sets.first = np.array([20, 20]), np.array([0, 20, 40])
    keys, owner = sets.keys(90)
    assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_ngram_join_of_five_words(spark, corpus):
    named = ngram_join.near_copies(documents(spark, corpus), words=5, percent=80)
    rows = [(r[0], r[1], r[2]) for r in corpus]
    sets = {i: shingles(t, 5) for i, (_, t, _) in enumerate(rows)}
    got = sum(r.n_links for r in named.collect())
    want = sum(1 for i in sets for j in sets if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert got == want
    kept = ngram_join.representatives(documents(spark, corpus), words=5, percent=80).collect()
    names = [r.component_id for r in named.collect()]
    assert len([r for r in kept if r.doc_id == 307]) <= 1
    assert {r.doc_id for r in kept if (r.text or "").strip() and r.doc_id is not None} == {n for n, r in zip(names, names) if n is not None} - {300, 301, 302}


def test_ngram_join_of_nothing(spark):
    assert ngram_join.near_copies(documents(spark, []).withColumn("set", F.lit(1))).count() == 0


# substring dedup


def removed(rows, width):
    texts = [(t or "").encode().split() for _, t, _ in rows]
    starts = {}
    for i, words in enumerate(texts):
        for j in range(len(words) - width + 1):
            starts.setdefault(tuple(words[j : j + width]), []).append((i, j))
    gone = [[False] * len(w) for w in texts]
    for places in starts.values():
        if len(places) > 1:
            for i, j in places:
                gone[i][j : j + width] = [True] * width
    out = []
    for (doc_id, _, _), words, flags in zip(rows, texts, gone):
        kept = b" ".join(w for w, g in zip(words, flags) if not g)
        out.append(repr((doc_id, len(words), sum(flags), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("heavy", [substring_dedup.HEAVY_ROWS, 2])
def test_substring_dedup_matches_brute_force(spark, tmp_path, corpus, heavy, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY_ROWS", heavy)
    rows = [*corpus, (400, prose(1, 100) + " " + prose(2, 50) + " " + prose(1, 100), "s"), (401, " ".join(["a"] * 200), "s")]
    got = queries.op5_substring_dedup(spark, stored(spark, tmp_path, rows, 5)).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == removed(rows, 35)


def test_substring_dedup_width_and_clashing_columns(spark):
    df = documents(spark, [(1, "a b c d e", ""), (2, "x a b c y", ""), (3, None, "")])
    df = df.withColumn("row", F.lit(1)).withColumn("key", F.lit(2)).withColumn("id", F.lit("i"))
    got = {r.id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeated(df, width=3).collect()}
    assert got == {1: (5, 3, "d e"), 2: (5, 3, "x y"), 3: (0, 0, "")}
    assert substring_dedup.remove_repeated(df.limit(0)).count() == 0


# fingerprints


def five_words(text):
    words = (text or "").encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_exact_sets(spark, tmp_path, corpus):
    rows = [r for r in corpus if r[0] is not None]
    got = queries.op8_fingerprints(spark, stored(spark, tmp_path, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""), reverse=True)
    want = {}
    for at, (doc_id, text, _) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        third = len(text) // 3
        edit = text[: len(text) - third] + after[:third]
        want.setdefault(doc_id, []).append((len(text), hashlib.sha256(edit.encode()).hexdigest(),
                                            likeness(five_words(text), five_words(edit)),
                                            likeness(five_words(text), five_words(after))))
    assert len(got) == len(rows)
    far = []
    for r in got:
        assert (r.n_chars, r.edited_sha256) in [w[:2] for w in want[r.doc_id]]
        if len(want[r.doc_id]) == 1:
            far += [abs(r.near_edited - want[r.doc_id][0][2]), abs(r.near_next - want[r.doc_id][0][3])]
    assert max(far) < 0.2 and sum(far) / len(far) < 0.03
    texts = {r[0]: r[1] for r in rows}
    prints = {}
    for r in got:
        prints.setdefault(texts[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_small_fingerprints_are_exact_and_merge(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "c d e f g h"), (2, None), (3, "x y"), (None, "x y")], "k long, text string")
    sketched = fingerprints.with_sketch(df, "text", "sketch")
    counts = {(r.k, r.text): r.n for r in sketched.select("k", "text", fingerprints.distinct_shingles(F.col("sketch")).alias("n")).collect()}
    assert counts[1, "a b c d e f g"] == 3 and counts[2, None] == 0 and counts[3, "x y"] == 1
    whole = {r.k: len(r.sketch) for r in fingerprints.merge_parts(sketched, "k", "sketch").collect()}
    assert whole == {1: 4, 2: 0, 3: 1, None: 1}
    pair = sketched.where("k = 1").groupBy().agg(F.min("sketch").alias("a"), F.max("sketch").alias("b"))
    row = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert row.r == pytest.approx(1 / 4) and row.c in (pytest.approx(1 / 3), pytest.approx(1 / 2))
    assert fingerprints.merge_parts(sketched.limit(0), "k", "sketch").count() == 0


def test_estimates_of_large_sketches(spark):
    text = lambda a, b: " ".join(str(i) for i in range(a, b))
    df = spark.createDataFrame([(text(0, 6000), text(3000, 9000))], "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "x", size=1024), "b", "y", size=1024)
    x, y = F.col("x"), F.col("y")
    row = df.select(fingerprints.resemblance(x, y, 1024).alias("r"), fingerprints.containment(x, y, 1024).alias("c"),
                    fingerprints.distinct_shingles(x, 1024).alias("n")).first()
    assert row.r == pytest.approx(1 / 3, abs=0.06) and row.c == pytest.approx(0.5, abs=0.1)
    assert row.n == pytest.approx(5996, rel=0.12)


def test_next_text_with_ties_and_nulls(spark):
    rows = [(5, "a"), (5, "b"), (None, "n"), (3, "c"), (9, "z"), (5, "b")] + [(i, f"t{i}") for i in range(100, 160)]
    got = sorted((repr((r.id, r.text, r.next)) for r in with_next_text(spark.createDataFrame(rows, "id long, text string"), "next").collect()))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    assert got == sorted(repr((*r, order[(i + 1) % len(order)][1])) for i, r in enumerate(order))
    for few in ([], [(None, "n")], [(None, "n"), (None, "m")], [(1, "x")]):
        found = with_next_text(spark.createDataFrame(few, "id long, text string"), "next").collect()
        assert len(found) == len(few) and all(r.next is not None for r in found)
