import datetime as dt

import pytest

from millrace import history

NOW = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)


def day(n):
    return dt.datetime(2024, 5, n, tzinfo=dt.UTC)


@pytest.fixture
def runs(spark):
    rows = [
        (1, "p", "succeeded", day(1)),
        (2, "p", "running", day(1)),
        (3, "q", "cancelled", day(2)),
        (4, "q", "failed", dt.datetime(2024, 6, 2, tzinfo=dt.UTC)),
        (5, "p", "completed_with_warnings", NOW.replace(tzinfo=dt.UTC)),
    ]
    return spark.createDataFrame(rows, "id int, pipeline_id string, state string, expires_at timestamp")


def ids(df):
    return [r.id for r in df.collect()]


def test_expired_datasets_are_bounded_and_oldest_first(spark, runs):
    rows = [(10, 1, day(3)), (11, 2, day(1)), (12, 3, day(2)), (13, 3, day(2)), (14, 9, day(1)), (15, 1, None)]
    datasets = spark.createDataFrame(rows, "id int, run_id int, expires_at timestamp")
    assert ids(history.expired_datasets(datasets, runs, NOW)) == [12, 13, 10]
    assert ids(history.expired_datasets(datasets, runs, NOW, limit=2)) == [12, 13]
    with pytest.raises(Exception):
        history.expired_datasets(datasets, runs, NOW, limit=0)


def test_a_run_with_most_of_the_rows_does_not_change_the_result(spark, runs):
    hot = spark.range(0, 20_000).selectExpr(
        "id", "IF(id % 3 = 0, 1, CAST(id % 7 AS INT)) AS run_id", "TIMESTAMP'2024-05-05' AS expires_at"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = history.expired_datasets(hot, runs, NOW, limit=None)
        ended = {1, 3, 4, 5}
        want = sum((1 if i % 3 == 0 else i % 7) in ended for i in range(20_000))
        assert found.count() == want
        assert ids(history.deletable_runs(runs, NOW, hot.where("run_id <> 3"))) == [3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_expired_records(runs):
    assert ids(history.expired_records(runs, NOW)) == [1, 2, 3, 5]
    assert ids(history.expired_records(runs, NOW, terminal=True)) == [1, 3, 5]
    assert ids(history.expired_records(runs, NOW.replace(tzinfo=None), terminal=True)) == [1, 3, 5]


def test_deletable_runs(spark, runs):
    logs = spark.createDataFrame([(7, 3)], "id int, run_id int")
    none = spark.createDataFrame([], "id int, run_id int")
    assert sorted(ids(history.deletable_runs(runs, NOW, none, none, none))) == [1, 3, 5]
    assert sorted(ids(history.deletable_runs(runs, NOW, logs, none, none))) == [1, 5]


def test_claims(spark):
    uploads = spark.createDataFrame([(1, "o", "a"), (2, "o", "b"), (3, "x", "a")], "id int, owner_id string, location string")
    claims = spark.createDataFrame([("o", "a"), ("o", "a"), ("o", "z")], "owner_id string, location string")
    claimed, rest = history.claim_uploads(uploads, claims)
    assert ids(claimed) == [1] and sorted(ids(rest)) == [2, 3]


def test_state_counts(spark):
    jobs = spark.createDataFrame([("queued",), ("done",), ("queued",)], "state string")
    assert dict(map(tuple, history.state_counts(jobs).collect())) == {"queued": 2, "running": 0}
    assert dict(map(tuple, history.state_counts(jobs.limit(0)).collect())) == {"queued": 0, "running": 0}


def test_checkpoint_upsert(spark, runs):
    old = spark.createDataFrame([("p", "s", "old", day(1))], "pipeline_id string, source_id string, checkpoint string, updated_at timestamp")
    rows = [
        ("p", "s", "lost", day(9), 2), ("p", "s", "new", day(3), 1), ("q", "s", "other pipeline", day(3), 1),
        ("p", "t", "first", day(2), 5), ("q", "t", "cancelled", day(2), 3),
    ]
    candidates = spark.createDataFrame(rows, "pipeline_id string, source_id string, checkpoint string, updated_at timestamp, run_id int")
    out = history.upsert_checkpoints(old, candidates, runs).collect()
    assert sorted((r.pipeline_id, r.source_id, r.checkpoint) for r in out) == [
        ("p", "s", "new"), ("p", "t", "first"),
    ]


def test_expiry_counts_whole_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 28, 13),)], "created_at timestamp_ntz")
    assert history.stamp_expiry(df, 2).first().expires_at == dt.datetime(2024, 3, 1, 13)
    assert history.stamp_expiry(df).first().expires_at == dt.datetime(2025, 2, 27, 13)
    for bad in (0, -1, 1.5, True):
        with pytest.raises(Exception):
            history.stamp_expiry(df, bad)


def test_metrics_are_plain_counters():
    assert history.checked_metrics({"records_read": 3})["records_read"] == 3
    assert history.checked_metrics({"bytes_read": 2**50})["bytes_read"] == 2**50
    for bad in ({"records_read": -1}, {"rows": 1}, {"duration_ms": True}, {"bytes_read": 1.5}):
        with pytest.raises(ValueError):
            history.checked_metrics(bad)
