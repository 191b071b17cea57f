import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from millrace import DataError, DeduplicateRows, Documents, FlattenDocument, SchemaError, SortRows, Table
from millrace.functions.positions import numbered
from millrace.operators.rows import LimitRows
from millrace.sinks import storage
from millrace.sinks.artifacts import ArtifactStore
from millrace.sinks.datasets import DatasetStore, Lifecycle
from millrace.sinks.files import CsvSink, JsonSink, ParquetSink
from millrace.sinks.relational import FolderTarget, JdbcTarget, RelationalSink, stage_name, statements
from millrace.sources.delimited import DelimitedSource
from millrace.sources.documents import JsonSource
from workloads import QUERIES

RUN = Lifecycle("pipe", "run1")


@pytest.fixture
def orders(spark):
    df = spark.createDataFrame([(41, 6.0), (40, 0.75)], "shelf bigint, weight double")
    return Table.of(df.coalesce(1), ["shelf"])


def text(path, spark):
    lines = spark.read.text(path, wholetext=True).orderBy("_metadata.file_path").collect()
    return [r[0] for r in lines]


def rows(table):
    return [tuple(r) for r in table.sorted_frame().collect()]


def test_csv_text(spark, scratch, orders):
    CsvSink("orders.csv").write(orders, f"{scratch}/o")
    parts = text(f"{scratch}/o", spark)
    assert "".join(p.replace("shelf,weight\n", "") for p in parts) == "40,0.75\n41,6.0\n"
    assert all(p.startswith("shelf,weight\n") for p in parts)


def test_csv_keeps_nulls_empty_texts_quotes_and_spaces_apart(spark, scratch):
    data = [(1, None, dt.datetime(2024, 1, 2)), (2, "", None), (3, 'a"b,\n c ', None), (4, " x ", None)]
    table = Table.of(spark.createDataFrame(data, "n bigint, v string, t timestamp_ntz"), ["n"])
    CsvSink("a.csv").write(table, f"{scratch}/a")
    back = DelimitedSource("a")(spark, scratch)
    times = ["2024-01-02 00:00:00.000000", None, None, None]
    assert rows(back) == [(n, v, t) for (n, v, _), t in zip(data, times)]


def test_json_lines_and_arrays(spark, scratch):
    df = spark.createDataFrame([(i, None if i % 2 else "é") for i in range(5)], "n int, v string")
    table = Table.of(df.coalesce(1), ["n"])
    want = [{"n": i, "v": None if i % 2 else "é"} for i in range(5)]
    JsonSink("a.json", layout="lines").write(table, f"{scratch}/lines")
    lines = "".join(text(f"{scratch}/lines", spark)).splitlines()
    assert [json.loads(x) for x in lines] == want
    JsonSink("a.json", rows_per_array=2).write(table, f"{scratch}/arrays")
    arrays = [json.loads(x) for x in text(f"{scratch}/arrays", spark)]
    assert all(len(a) <= 2 for a in arrays)
    assert [r for a in arrays for r in a] == want


@pytest.fixture
def late_rows(spark, scratch):
    """A folder of one table, a file of one row group whose first splits offer no rows."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def written(df, table):
        df.coalesce(1).write.parquet(f"{scratch}/written")
        file = next(f for f in os.listdir(f"{scratch}/written") if f.endswith(".parquet"))
        os.makedirs(f"{scratch}/tables")
        os.rename(f"{scratch}/written/{file}", f"{scratch}/tables/{table}.parquet")
        size = os.path.getsize(f"{scratch}/tables/{table}.parquet")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size // 8 + 1)
        back = spark.read.parquet(f"{scratch}/tables/{table}.parquet")
        assert back.select(F.spark_partition_id().alias("split")).agg(F.min("split")).first()[0] > 0
        return f"{scratch}/tables"

    yield written
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_documents_of_a_table_whose_first_partition_is_empty(spark, late_rows):
    said = "IF(id % 3 = 0, 'system', 'user') AS role"
    folder = late_rows(spark.range(5000).selectExpr("id AS conv_id", "id % 7 AS turn", said), "conversations")
    found = QUERIES["pipe_documents"].run(spark, folder)
    assert sorted(map(tuple, found.collect())) == [(i, i % 7, "user") for i in range(5000) if i % 3]


def test_arrays_of_orders_whose_first_partition_is_empty(spark, late_rows):
    columns = ("id AS o_orderkey", "id % 9 AS o_custkey", "'O' AS o_orderstatus", "id / 4 AS o_totalprice")
    folder = late_rows(spark.range(5000).selectExpr(*columns), "orders")
    found = QUERIES["src_json_docs"].run(spark, folder)
    assert sorted(map(tuple, found.collect())) == [(i, i % 9, "O", i / 4) for i in range(5000)]


def test_json_arrays_of_partitions_without_rows(spark, scratch):
    df = spark.range(0, 6, 1, 3)
    JsonSink("a.json", rows_per_array=2).write(Table.of(df.where("id > 1")), f"{scratch}/late")
    arrays = [json.loads(x) for x in text(f"{scratch}/late", spark)]
    assert arrays == [[], [{"id": 2}, {"id": 3}], [{"id": 4}, {"id": 5}]]
    assert rows(FlattenDocument()(JsonSource("late")(spark, scratch))) == [(i,) for i in range(2, 6)]
    nothing = spark.range(0)
    assert nothing.rdd.getNumPartitions() == 0
    for name, empty in (("none", df.where("id < 0")), ("nothing", nothing)):
        JsonSink("a.json").write(Table.of(empty), f"{scratch}/{name}")
        assert [json.loads(x) for x in text(f"{scratch}/{name}", spark)] == [[]]
        assert FlattenDocument()(JsonSource(name)(spark, scratch)).df.count() == 0


def test_json_arrays_keep_a_sort(spark, scratch):
    df = spark.range(0, 10_000).repartition(7).selectExpr("id", "id % 10 AS k")
    table = SortRows([{"column": "k", "descending": True}])(Table.of(df, ["id"]))
    JsonSink("a.json", rows_per_array=900).write(table, f"{scratch}/a")
    found = [r["id"] for x in text(f"{scratch}/a", spark) for r in json.loads(x)]
    assert found == sorted(range(10_000), key=lambda i: (-(i % 10), i))


def test_json_keeps_microseconds(spark, scratch):
    moment = "2024-01-02 03:04:05.000006"
    df = spark.sql(f"SELECT TIMESTAMP_NTZ'{moment}' AS plain, TIMESTAMP'{moment}' AS zoned")
    JsonSink("a.json").write(Table.of(df), f"{scratch}/a")
    want = {"plain": "2024-01-02T03:04:05.000006", "zoned": "2024-01-02T03:04:05.000006Z"}
    assert json.loads("".join(text(f"{scratch}/a", spark))) == [want]


def test_parquet_keeps_a_sort(spark, scratch):
    df = spark.range(0, 10_000).repartition(7).selectExpr("id", "id % 10 AS k")
    table = SortRows([{"column": "k", "descending": True}])(Table.of(df, ["id"]))
    ParquetSink("a.parquet").write(table, f"{scratch}/a")
    out = spark.read.parquet(f"{scratch}/a").orderBy("_metadata.file_path", "_metadata.row_index")
    got = [(r.k, r.id) for r in out.collect()]
    assert got == sorted(got, key=lambda x: (-x[0], x[1])) and len(got) == 10_000


def test_positions_and_large_limits(spark):
    df = spark.range(0, 5000).repartition(5)
    table = SortRows([{"column": "id", "descending": True}])(Table.of(df, ["id"]))
    assert [tuple(r) for r in numbered(table, "at").frame().where("id + at <> 4999").collect()] == []
    cut = LimitRows(1234)(table)
    assert [r[0] for r in cut.sorted_frame().collect()] == list(range(4999, 4999 - 1234, -1))
    assert LimitRows(1234)(Table.of(df)).frame().count() == 1234


# -- artifacts --------------------------------------------------------------------


def test_publish_records_after_writing(spark, scratch, orders):
    store = ArtifactStore(spark, scratch)
    artifact = store.publish(orders, CsvSink("orders.csv"), RUN)
    assert artifact.retention_days == 30 and artifact.size_bytes > 0
    kept = store.manifest().collect()
    assert [(r.id, r.content_type, r.location) for r in kept] == [
        (artifact.id, "text/csv", artifact.location)
    ]


def test_publish_leaves_nothing_behind_on_failure(spark, scratch, orders):
    def broken(row):
        raise OSError("no database")

    with pytest.raises(DataError, match="could not be recorded"):
        ArtifactStore(spark, scratch, record=broken).publish(orders, CsvSink("o.csv"), RUN)
    failing = Table(spark.range(4).selectExpr("raise_error('x') AS v"))
    with pytest.raises(Exception):
        ArtifactStore(spark, scratch).publish(failing, ParquetSink("o.parquet"), RUN)
    left = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch}/runs/run1/artifacts/*")
    files = left.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(left)
    assert list(files or []) == []


def test_lifecycles_are_checked(spark, scratch, orders):
    past = Lifecycle("p", "r", expires_at=dt.datetime(2020, 1, 1, tzinfo=dt.UTC))
    naive = Lifecycle("p", "r", expires_at=dt.datetime(2999, 1, 1))
    for lifecycle in (past, naive):
        with pytest.raises(ValueError):
            ArtifactStore(spark, scratch).publish(orders, CsvSink("o.csv"), lifecycle)
    for name in ("../o.csv", "a/b.csv", "", ".."):
        with pytest.raises(Exception):
            CsvSink(name)


# -- datasets ---------------------------------------------------------------------


def test_datasets_keep_rows_order_and_structure(spark, scratch):
    df = spark.range(0, 1000).repartition(4).selectExpr("id", "cast(null as string) AS `a.b`")
    table = SortRows([{"column": "id", "descending": True}])(Table.of(df, ["id"]))
    store = DatasetStore(spark, scratch)
    descriptor = store.persist(table, RUN)
    again = DatasetStore(spark, scratch).table(descriptor.id)
    assert again.columns == ["id", "a.b"]
    assert [r.id for r in again.ordered_frame().collect()] == list(range(999, -1, -1))
    assert json.loads(descriptor.structure) == [["id", "bigint", False], ["a.b", "string", True]]
    with pytest.raises(SchemaError):
        store.documents(descriptor.id)
    with pytest.raises(DataError):
        store.open("gone")
    spark.range(3).write.mode("overwrite").parquet(descriptor.location)
    with pytest.raises(Exception):
        store.open(descriptor.id)


def test_batches_take_the_schema_of_the_first(spark, scratch):
    store = DatasetStore(spark, scratch)
    first = spark.createDataFrame([(2, "b")], "id bigint, name string")
    second = spark.createDataFrame([("a", 1), ("c", 3)], "name string, id int")
    table = store.table(store.persist_batches([first, second], RUN))
    assert rows(table) == [(2, "b"), (1, "a"), (3, "c")]
    assert table.schema.simpleString() == "struct<id:bigint,name:string>"
    assert store.table(store.persist_batches([], RUN)).columns == []
    with pytest.raises(SchemaError):
        store.persist_batches([first, second.drop("id")], RUN)


def test_documents_are_checked_and_compact(spark, scratch):
    store = DatasetStore(spark, scratch)
    bodies = ['{ "a" : [1, 2],\n "é": null }', '\n"x"\t', " null ", "7"]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    saved = store.persist_documents(Documents.of(df, "body", ["n"]), RUN)
    kept = store.documents(saved.id)
    back = kept.df.orderBy(*[k.column for k in kept.order]).collect()
    assert [r.body for r in back] == ['{"a":[1,2],"é":null}', '"x"', "null", "7"]
    for text_ in ('{"a": NaN}', '"x', '"x" 1'):
        bad = spark.createDataFrame([(0, text_)], "n int, body string")
        with pytest.raises(Exception, match="not valid JSON"):
            store.persist_documents(Documents.of(bad, "body", ["n"]), RUN)
    assert store.manifest().count() == 1


# -- tables -----------------------------------------------------------------------


def test_folder_replace_is_whole_or_not_at_all(spark, scratch, orders):
    target = FolderTarget(scratch, {})
    sink = RelationalSink("orders")
    sink.write(orders, "r1", target)
    failing = Table(spark.range(4).selectExpr("id AS shelf", "raise_error('x') AS weight"))
    with pytest.raises(Exception):
        sink.write(failing, "r2", target)
    assert spark.read.parquet(f"{scratch}/orders").count() == 2
    sink.write(Table(orders.frame().limit(1)), "r3", target)
    assert spark.read.parquet(f"{scratch}/orders").count() == 1


def test_folder_append_is_safe_to_repeat(spark, scratch):
    target = FolderTarget(scratch, {"t": ["a", "b"]})
    sink = RelationalSink("t", "append")

    def table(data):
        df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "n int, a int, b string, v string")
        return Table.of(df, ["n"]).project([df["a"], df["b"], df["v"]])

    load = table([(1, "x", "first"), (1, "x", "second"), (1, None, "loose")])
    sink.write(load, "r1", target)
    sink.write(load, "r1", target)
    sink.write(table([(1, "x", "late"), (2, "x", "new")]), "r2", target)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{scratch}/t").select("a", "v").collect())
    # A null in a key never conflicts, as in SQL.
    assert got == [(1, "first"), (1, "loose"), (1, "loose"), (2, "new")]


class FakeConnection:
    """Records statements; may fail on one of them."""

    def __init__(self, fail_on=None):
        self.log = []
        self.fail_on = fail_on

    def setAutoCommit(self, on):
        self.log.append(("auto", on))

    def createStatement(self):
        return FakeStatement(self)

    def commit(self):
        self.log.append("COMMIT")

    def rollback(self):
        self.log.append("ROLLBACK")

    def close(self):
        self.log.append("CLOSE")


class FakeStatement:
    def __init__(self, connection):
        self.connection = connection

    def execute(self, text):
        self.connection.log.append(text)
        if self.connection.fail_on and text.startswith(self.connection.fail_on):
            raise RuntimeError("s3cret")

    def close(self):
        pass


def jdbc(connection, staged):
    def load(rows, stage):
        staged.append((stage, sorted(tuple(r) for r in rows.collect())))

    return JdbcTarget("jdbc:x:s3cret", connect=lambda spark: connection, load=load)


def test_jdbc_replace_is_one_transaction(spark, orders):
    connection, staged = FakeConnection(), []
    RelationalSink("sales.orders").write(orders, "run-1", jdbc(connection, staged))
    sql = statements("sales.orders", ["shelf", "weight"], "replace", "run-1")
    auto, manual = ("auto", True), ("auto", False)
    assert connection.log == [
        auto, sql.drop_stage, sql.create_stage,
        manual, *sql.deliver, "COMMIT", auto, sql.drop_stage, "CLOSE",
    ]
    assert sql.deliver[0] == 'TRUNCATE TABLE "sales"."orders"'
    stage, rows_ = staged[0]
    assert stage == f'"{stage_name("run-1")}"' and len(stage) <= 65
    assert [r[:2] for r in rows_] == [(40, 0.75), (41, 6.0)]
    assert len({r[2:] for r in rows_}) == 2


def test_jdbc_append_skips_conflicts_and_failures_roll_back(spark, orders):
    sql = statements("orders", ["shelf"], "append", "r")
    assert len(sql.deliver) == 1 and sql.deliver[0].endswith("ON CONFLICT DO NOTHING")
    connection = FakeConnection(fail_on="INSERT")
    with pytest.raises(DataError, match="rolled back") as error:
        RelationalSink("orders", "append").write(orders, "r", jdbc(connection, []))
    assert "s3cret" not in str(error.value)
    assert "ROLLBACK" in connection.log and "COMMIT" not in connection.log
    assert connection.log[-1] == "CLOSE"


def test_table_names_are_identifiers(orders):
    for name in ("a;b", "a.b.c", 'x"y', "1a", "a" * 64, ""):
        with pytest.raises(Exception):
            RelationalSink(name)
    assert "s3cret" not in repr(JdbcTarget("jdbc:x:s3cret"))


def test_storage_swap_restores_the_old_folder(spark, scratch):
    spark.range(2).write.parquet(f"{scratch}/t")
    with pytest.raises(Exception):
        storage.swap_in(spark, f"{scratch}/missing", f"{scratch}/t", "r")
    assert spark.read.parquet(f"{scratch}/t").count() == 2


def test_dedup_then_write_keeps_the_order(spark, scratch):
    df = spark.range(0, 1000).selectExpr("id AS n", "id % 50 AS k").repartition(5)
    ParquetSink("a.parquet").write(DeduplicateRows(["k"])(Table.of(df, ["n"])), f"{scratch}/a")
    out = spark.read.parquet(f"{scratch}/a").orderBy("_metadata.file_path", "_metadata.row_index")
    assert [r.n for r in out.collect()] == list(range(50))


def test_a_clean_up_that_fails_leaves_a_delivery_delivered(spark, orders):
    connection = FakeConnection()
    sql = statements("t", ["shelf", "weight"], "replace", "r")
    jdbc(connection, []).deliver(orders, "t", "replace", "r")
    broken = FakeConnection()
    broken.close = lambda: (_ for _ in ()).throw(OSError("gone"))
    drops = iter([None])

    def execute(statement, text, plain=FakeStatement.execute):
        if text == sql.drop_stage and next(drops, "again") == "again":
            raise OSError("gone")
        plain(statement, text)

    original, FakeStatement.execute = FakeStatement.execute, execute
    try:
        jdbc(broken, []).deliver(orders, "t", "replace", "r")
    finally:
        FakeStatement.execute = original
    assert "COMMIT" in broken.log and "ROLLBACK" not in broken.log


def test_stage_names_differ_for_runs_alike():
    names = {stage_name(run) for run in ("a-b", "ab", "x" * 60 + "1", "x" * 60 + "2")}
    assert len(names) == 4 and all(len(n) <= 63 for n in names)


def test_large_documents_are_stored_whole(spark, scratch):
    body = json.dumps({"a": "x" * 21_000_000, "_corrupt_record": 1, "n": [1.5, "\u2028", None]})
    store = DatasetStore(spark, scratch)
    kept = store.persist_documents(Documents.of(spark.createDataFrame([(body,)], "v string"), "v"), RUN)
    back = store.documents(kept).df.select("body").collect()
    assert len(back) == 1 and json.loads(back[0][0]) == json.loads(body)


def test_exported_json_is_read_by_a_pipeline(spark, scratch):
    from millrace.plans.pipeline import Context, Pipeline

    rows_ = spark.createDataFrame([(i, None if i % 3 else f"v{i}") for i in range(50)], "n bigint, v string")
    CsvSink("a.csv").write(Table.of(rows_, ["n"]), f"{scratch}/in/a")
    export = {"type": "export.json", "config": {"fileName": "o.json", "rowsPerArray": 7}}
    first = Pipeline.of([{"type": "source.csv", "config": {"sourcePath": "a"}}, export])
    artifact = first.run(Context(spark, f"{scratch}/in", f"{scratch}/out")).artifact
    folder = artifact.location.removeprefix(f"{scratch}/out/")
    second = Pipeline.of([
        {"type": "source.json", "config": {"sourcePath": folder, "layout": "file"}},
        {"type": "transform.document.flatten", "config": {}},
        {"type": "export.parquet", "config": {"fileName": "o.parquet"}},
    ])
    result = second.run(Context(spark, f"{scratch}/out", f"{scratch}/out2"))
    back = spark.read.parquet(result.artifact.location)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows_.collect()), key=str)
