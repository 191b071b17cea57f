"""Tables of numbered snapshots: one-step replacement, conflicts and lost writers."""

import json

import pytest

from millrace import DataError, Table
from millrace.sinks import snapshots, storage
from millrace.sinks.relational import RelationalSink
from millrace.sinks.snapshots import SnapshotTarget


def numbers(spark, low, high, step=1, word="x"):
    rows = [(i, f"{word}{i}") for i in range(low, high, step)]
    return Table.of(spark.createDataFrame(rows, "k int, v string").coalesce(1), ["k"])


def keys(target, spark):
    return sorted(r.k for r in target.read(spark, "t").collect())


def test_a_reader_sees_the_old_or_the_new_table(spark, scratch, monkeypatch):
    target = SnapshotTarget(scratch, {})
    sink = RelationalSink("t")
    with pytest.raises(DataError):
        target.read(spark, "t")
    sink.write(numbers(spark, 0, 10), "a", target)
    before = target.read(spark, "t")
    create, written, seen = storage.create_text, SnapshotTarget._written, []

    def looked(step):
        seen.append((step, keys(target, spark)))

    def writes(*args):
        looked("before the parts")
        out = written(*args)
        looked("after the parts")
        return out

    def lost(spark, path, text):
        create(spark, path, text.removesuffix(snapshots.END))  # the writer ends within the file
        looked("within the snapshot")
        raise OSError("lost")

    monkeypatch.setattr(SnapshotTarget, "_written", staticmethod(writes))
    monkeypatch.setattr(storage, "create_text", lost)
    with pytest.raises(Exception):
        sink.write(numbers(spark, 20, 25), "b", target)
    assert [k for _, k in seen] == [list(range(10))] * 3
    monkeypatch.setattr(storage, "create_text", create)
    monkeypatch.setattr(SnapshotTarget, "_written", staticmethod(written))
    sink.write(numbers(spark, 30, 33), "c", target)
    assert keys(target, spark) == [30, 31, 32]
    # A frame read before still reads its own state.
    assert sorted(r.k for r in before.collect()) == list(range(10))
    assert snapshots.snapshot_numbers(spark, f"{scratch}/t") == [1, 2, 3]


def test_two_writers_lose_nothing(spark, scratch, monkeypatch):
    target = SnapshotTarget(scratch, {"t": ["k"]})
    sink = RelationalSink("t", "append")
    sink.write(numbers(spark, 0, 5), "a", target)
    create = storage.create_text

    def late(spark_, path, text):
        monkeypatch.setattr(storage, "create_text", create)
        sink.write(numbers(spark, 3, 8, word="other"), "b", target)  # another writer is faster
        return create(spark_, path, text)

    monkeypatch.setattr(storage, "create_text", late)
    sink.write(numbers(spark, 4, 12, word="mine"), "c", target)
    got = {r.k: r.v for r in target.read(spark, "t").collect()}
    assert target.read(spark, "t").count() == len(got) == 12
    assert got[4] == "x4" and got[7] == "other7" and got[11] == "mine11"


def test_appends_read_only_parts_their_keys_can_be_in(spark, scratch):
    target = SnapshotTarget(scratch, {"t": ["k", "v"]})
    for run in range(4):
        RelationalSink("t", "append").write(numbers(spark, 100 * run, 100 * run + 50), f"r{run}", target)
    known = snapshots.latest(spark, f"{scratch}/t")
    assert len(known.parts) == 4 and all(json.loads(p)["rows"] == 50 for p in known.parts)
    near = target._candidates(numbers(spark, 120, 130), ["k", "v"], known)
    assert [json.loads(p)["low"]["k"] for p in near] == [100]
    assert target._candidates(numbers(spark, 60, 90), ["k", "v"], known) == []
    RelationalSink("t", "append").write(numbers(spark, 140, 160), "again", target)
    assert keys(target, spark) == sorted([*range(50), *range(100, 160), *range(200, 250), *range(300, 350)])
    with pytest.raises(DataError):
        RelationalSink("t", "append").write(Table.of(spark.range(3).toDF("k").selectExpr("k", "'a' AS v", "1 AS w"), ["k"]), "w", target)


def test_nulls_empty_loads_and_expiry(spark, scratch):
    target = SnapshotTarget(scratch, {"t": ["k"]})
    sink = RelationalSink("t", "append")
    sink.write(numbers(spark, 0, 0), "none", target)
    assert target.read(spark, "t").columns == ["k", "v"] and keys(target, spark) == []
    nulls = Table.of(spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "c")], "k int, v string").coalesce(1), ["v"])
    sink.write(nulls, "n1", target)
    sink.write(nulls, "n2", target)
    rows = [(r.k, r.v) for r in target.read(spark, "t").collect()]
    assert sorted(rows, key=repr) == [(1, "b")] + [(None, "a")] * 4
    RelationalSink("t").write(numbers(spark, 7, 9), "all", target)
    target.expire(spark, "t", keep=1)
    assert keys(target, spark) == [7, 8] and len(storage.folders(spark, f"{scratch}/t/data")) == 1
