import json
import os

import pytest

from millrace import ConfigError, DataError, SchemaError
from millrace.plans.catalog import COMPONENTS
from millrace.plans.pipeline import Context, Pipeline
from millrace.sinks import storage
from millrace.sinks.relational import FolderTarget
from millrace.sources.pages import PagedSource
from millrace.sources.relational import (
    CatalogDatabase,
    JdbcDatabase,
    RelationalSource,
    sql_literal,
)
from millrace.streaming.checkpoints import CheckpointStore, checked_json, run_with_checkpoint
from test_sources import FakeApi, page

CSV = {"type": "source.csv", "config": {"sourcePath": "orders.csv"}}
OUT = {"type": "export.csv", "config": {"fileName": "out.csv"}}


def put_orders(scratch):
    with open(f"{scratch}/orders.csv", "w") as file:
        file.write("order_id,customer,total\n11, Ada ,70\n12,Brook,30\n13,Ada,55\n")


def step(type_name, **config):
    return {"type": f"transform.{type_name}", "config": config}


def test_the_catalog_is_complete():
    kinds = [c.kind for c in COMPONENTS.values()]
    assert (kinds.count("source"), kinds.count("transform"), kinds.count("export")) == (5, 13, 4)


def test_csv_to_csv(spark, scratch):
    put_orders(scratch)
    pipeline = Pipeline.of(
        [
            CSV,
            step("values.normalize-string", column="customer", operation="trim"),
            step("rows.filter", column="total", operator="greaterThan", value=40),
            step("rows.sort", columns=[{"column": "total"}]),
            step("columns.select", columns=["customer", "total"]),
            OUT,
        ]
    )
    context = Context(spark, scratch, f"{scratch}/out", measure="all")
    result = pipeline.run(context)
    text = spark.read.text(result.artifact.location, wholetext=True)
    parts = [r[0] for r in text.orderBy("_metadata.file_path").collect()]
    assert "".join(p.split("\n", 1)[1] for p in parts) == "Ada,55\nAda,70\n"
    counted = {k: v["records_written"] for k, v in result.metrics.items()}
    assert list(counted.values()) == [3, 3, 2, 2, 2, 2]
    states = spark.read.parquet(f"{scratch}/out/history/runs").collect()
    assert [(r.id, r.state) for r in states] == [(result.run_id, "succeeded")]
    events = {r.step: r for r in spark.read.parquet(f"{scratch}/out/history/events").collect()}
    assert list(result.metrics) == [s.name for s in pipeline.steps] and len(events) == 6
    last = events["5:export.csv"]
    assert (last.records_written, last.retry_attempt) == (2, 0) and last.bytes_written > 0
    assert events["0:source.csv"].bytes_read == os.path.getsize(f"{scratch}/orders.csv")
    assert events["2:transform.rows.filter"].records_read == 3


def test_filters_reach_the_scan_of_one_plan(spark, scratch):
    spark.range(10).selectExpr("id", "id * 2 AS v", "id AS unused").write.parquet(f"{scratch}/t")
    spark.read.parquet(f"{scratch}/t").createOrReplaceTempView("pushed")
    pipeline = Pipeline.of(
        [
            {"type": "source.postgres", "config": {"table": "pushed"}},
            step("columns.rename", renames={"v": "w"}),
            step("rows.filter", column="w", operator="lessThan", value=9),
            step("columns.select", columns=["w"]),
            OUT,
        ]
    )
    table = pipeline.plan(Context(spark, scratch, scratch, database=CatalogDatabase()))
    plan = table.frame()._jdf.queryExecution().toString()
    assert "LessThan(v,9)" in plan and "ReadSchema: struct<v:bigint>" in plan


@pytest.mark.parametrize(
    "steps",
    [
        [],
        [CSV],
        [OUT, CSV],
        [CSV, CSV, OUT],
        [CSV, {"type": "transform.rows.pivot"}, OUT],
        [{**CSV, "version": "v2"}, OUT],
        [{**CSV, "extra": 1}, OUT],
        [{"type": "source.csv", "config": {}}, OUT],
        [{"type": "source.csv", "config": {"sourcePath": "a", "other": 1}}, OUT],
        [{"type": "source.csv", "config": {"sourcePath": 1}}, OUT],
        [{"type": "source.csv", "config": {"sourcePath": "a", "hasHeader": "yes"}}, OUT],
        [CSV, step("rows.limit", count="3"), OUT],
        [CSV, step("rows.limit", count=True), OUT],
        [CSV, step("rows.limit", count=1.5), OUT],
        [CSV, step("rows.filter", column="a", operator="like", value=1), OUT],
        [CSV, step("document.flatten"), OUT],
        [{"type": "source.json", "config": {"sourcePath": "a"}}, OUT],
        [{"type": "source.json", "config": {"sourcePath": "a"}}, step("rows.limit", count=1), OUT],
        [CSV, {"type": "export.postgres", "config": {"targetTable": "t", "connectionUrl": "x"}}],
        [{**CSV, "secrets": {"apiToken": "b"}}, OUT],
        [CSV, {**OUT, "config": {"fileName": "o.csv", "keep_order": True}}],
    ],
)
def test_pipelines_are_checked_before_reading(steps):
    with pytest.raises(ConfigError):
        Pipeline.of(steps, resolve_secret=lambda name: "value")


def test_secrets_come_from_bindings():
    export = {
        "type": "export.postgres",
        "config": {"targetTable": "t"},
        "secrets": {"connectionUrl": "warehouse"},
    }
    pipeline = Pipeline.of([CSV, export], resolve_secret={"warehouse": "jdbc:x"}.get)
    assert pipeline.steps[-1].operator.connection_url == "jdbc:x"
    for resolver in (None, lambda name: ""):
        with pytest.raises(ConfigError):
            Pipeline.of([CSV, export], resolve_secret=resolver)


def test_a_missing_column_fails_while_planning(spark, scratch):
    put_orders(scratch)
    pipeline = Pipeline.of([CSV, step("columns.drop", columns=["gone"]), OUT])
    with pytest.raises(SchemaError):
        pipeline.plan(Context(spark, scratch, scratch))
    with pytest.raises(SchemaError):
        pipeline.run(Context(spark, scratch, f"{scratch}/out"), "r")
    states = spark.read.parquet(f"{scratch}/out/history/runs").collect()
    assert [(r.id, r.state) for r in states] == [("r", "failed")]


# -- incremental runs -------------------------------------------------------------

URL = "https://api.example.org/orders"


def api_pipeline():
    config = {
        "url": URL, "nextPagePath": "next", "checkpointPath": "mark", "checkpointParameter": "since",
    }
    return Pipeline.of(
        [
            {"type": "source.rest", "config": config},
            step("document.flatten", record_path=["pages"]),
            step("columns.select", columns=["order_id", "total"]),
            {"type": "export.postgres", "config": {"targetTable": "orders", "writeMode": "append"}},
        ]
    )


def order_page(order_id, mark):
    return {"order_id": order_id, "total": order_id / 2, "mark": mark, "next": None}


def test_api_to_table_commits_only_after_success(spark, scratch):
    store = CheckpointStore(spark, f"{scratch}/checkpoints")
    target = FolderTarget(scratch, {"orders": ["order_id"]})

    class Lost:
        def deliver(self, *arguments):
            target.deliver(*arguments)
            raise OSError("lost")

    api = FakeApi({URL: order_page(5, "m1"), f"{URL}?since=m1": order_page(6, "m2")})
    pipeline = api_pipeline()
    context = Context(spark, "", f"{scratch}/out", target=Lost(), transport=api, checkpoints=store)
    name = pipeline.steps[0].name
    with pytest.raises(OSError):
        pipeline.run(context, "r1")
    assert store.load("pipeline", name) is None
    good = Context(spark, "", f"{scratch}/out", target=target, transport=api, checkpoints=store)
    for expected in ("m1", "m2"):
        pipeline.run(good)
        assert store.load("pipeline", name) == {"pageToken": None, "value": expected}
    got = sorted(tuple(r) for r in spark.read.parquet(f"{scratch}/orders").collect())
    assert got == [(5, 2.5), (6, 3.0)]


def test_checkpoint_stores_keep_the_latest_of_successful_runs(spark, scratch):
    store = CheckpointStore(spark, f"{scratch}/c")
    assert store.load("p", "s") is None
    assert store.commit("p", "s", {"value": 1}, "r1", "succeeded")
    assert store.commit("p", "s", {"value": "é"}, "r2", "completed_with_warnings")
    assert not store.commit("p", "s", {"value": 3}, "r3", "failed")
    assert store.load("p", "s") == {"value": "é"}
    assert store.load("p", "other") is None
    for bad in (float("nan"), {"a": float("inf")}, object(), {1: 2}):
        with pytest.raises(Exception):
            checked_json(bad)


@pytest.mark.parametrize("after, kept", [(None, 1), (0, 2)])
def test_a_checkpoint_writer_that_is_overtaken_looks_again_or_gives_way(spark, scratch, monkeypatch, after, kept):
    store, create, overtaken = CheckpointStore(spark, f"{scratch}/c"), storage.create_text, []

    def late(session, path, text):
        if not overtaken:
            overtaken.append(path)
            assert store.commit("p", "s", 2, "r2", "succeeded")
        return create(session, path, text)

    monkeypatch.setattr(storage, "create_text", late)
    assert store.commit("p", "s", 1, "r1", "succeeded", after) == (after is None)
    assert store.load("p", "s") == kept
    assert [r.checkpoint for r in store.table().collect()] == [str(kept)]


def test_checkpoints_keep_two_files_a_key_and_pass_over_lost_writers(spark, scratch):
    store = CheckpointStore(spark, f"{scratch}/c")
    for n in range(1, 6):
        assert store.commit("p", "s", n, f"r{n}", "succeeded", after=n - 1)
    assert store.position("p", "s") == (5, 5)
    folder = f"{scratch}/c/{storage.folders(spark, f'{scratch}/c')[0]}"
    assert len(storage.visible_files(spark, folder)) == 2
    assert storage.create_text(spark, f"{folder}/{6:020d}", '{"pipeline_id": "p", "che')
    assert store.position("p", "s") == (5, 5)
    assert [(r.pipeline_id, r.checkpoint) for r in store.table().collect()] == [("p", "5")]
    assert store.commit("p", "s", 7, "r7", "succeeded")
    assert store.position("p", "s") == (7, 7)


def test_a_failing_commit_leaves_the_run_successful(spark, scratch):
    class Broken(CheckpointStore):
        def commit(self, *arguments):
            raise OSError("lost")

    states = []
    store = Broken(spark, f"{scratch}/c")
    with pytest.raises(OSError):
        run_with_checkpoint(store, ("p", "s"), "r", lambda value: 1, states.append)
    assert states == ["succeeded"]


# -- database sources -------------------------------------------------------------


def test_jdbc_options_hold_a_quoted_relation_and_the_fetch_size():
    database = JdbcDatabase("jdbc:x", {"driver": "d"})
    options = database.table_options("sales.orders", 500)
    assert options["dbtable"] == '"sales"."orders"' and options["fetchsize"] == "500"
    query = database.query_options("SELECT 1 WHERE a > %(checkpoint)s ORDER BY a", "x'y", 10)
    assert query["query"] == "SELECT 1 WHERE a > 'x''y' ORDER BY a"
    assert "jdbc" not in repr(database)
    assert [sql_literal(v) for v in (None, True, 3, 0.5)] == ["NULL", "TRUE", "3", "0.5"]


def test_jdbc_tables_are_read_over_many_connections(spark):
    asked = []

    def load(session, options):
        asked.append(options)
        return session.range(1).selectExpr("3 AS low", "90 AS high") if "query" in options else session.range(5)

    database = JdbcDatabase("jdbc:x", partition_column="id", connections=4, load=load)
    rows = RelationalSource(table="orders", chunk_size=7)(spark, database).frame()
    assert rows.count() == 5
    assert asked[0]["query"] == 'SELECT MIN("id") AS low, MAX("id") AS high FROM "orders"'
    wanted = {"partitionColumn": '"id"', "lowerBound": "3", "upperBound": "90", "numPartitions": "4"}
    assert wanted.items() <= asked[1].items() and asked[1]["fetchsize"] == "7"

    def broken(session, options):
        raise OSError("jdbc:s3cret")

    with pytest.raises(DataError) as error:
        RelationalSource(table="orders")(spark, JdbcDatabase("jdbc:x", load=broken))
    assert "s3cret" not in str(error.value)


def test_incremental_reads_push_the_predicate(spark, scratch):
    spark.range(20).selectExpr("id", "CAST(id AS DECIMAL(10,2)) AS d").write.parquet(f"{scratch}/t")
    spark.read.parquet(f"{scratch}/t").createOrReplaceTempView("incremental")
    source = RelationalSource(table="incremental", checkpoint_column="d")
    rows = source(spark, CatalogDatabase(), {"value": "16.50"}).frame()
    assert sorted(r.id for r in rows.collect()) == [17, 18, 19]
    assert "GreaterThan(d,16.50)" in rows._jdf.queryExecution().toString()
    assert source.candidate(rows) == {"value": "19.00"}
    assert source.candidate(rows.where("id > 99")) is None


@pytest.mark.parametrize(
    "settings",
    [
        {},
        {"table": "a", "query": "SELECT 1"},
        {"table": "a b"},
        {"table": "a.b.c"},
        {"table": "a" * 64},
        {"table": "a", "checkpoint_column": "x;y"},
        {"table": "a", "chunk_size": 0},
        {"table": "a", "chunk_size": 100_001},
        {"table": "a", "chunk_size": 1.5},
        {"query": "UPDATE t SET a = 1"},
        {"query": "SELECT 1; SELECT 2"},
        {"query": "SELECT * FROM t FOR UPDATE"},
        {"query": "SELECT * FROM t WHERE x IN (DELETE FROM u)"},
        {"query": "SELECT a FROM t ORDER BY a", "checkpoint_column": "a"},
        {"query": "SELECT a FROM t WHERE a > %(checkpoint)s", "checkpoint_column": "a"},
    ],
)
def test_database_configurations(settings):
    with pytest.raises(ConfigError):
        RelationalSource(**settings)


def test_a_checkpoint_query_gets_the_value_as_a_parameter(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    sql = "SELECT id FROM numbers WHERE id > coalesce(%(checkpoint)s, -1) ORDER BY id"
    source = RelationalSource(query=sql, checkpoint_column="id")
    assert source(spark, CatalogDatabase()).frame().count() == 5
    rows = source(spark, CatalogDatabase(), {"value": 2}).sorted_frame().collect()
    assert [r.id for r in rows] == [3, 4]


def test_checkpoints_of_another_shape_are_refused(spark):
    source = RelationalSource(table="x", checkpoint_column="a")
    for bad in ({"other": 1}, {"value": [1]}, {"value": None}, [1]):
        with pytest.raises(Exception, match="checkpoint"):
            source(spark, CatalogDatabase(), bad)


def test_secrets_are_not_shown():
    source = PagedSource("https://x", api_token="s3cret")
    assert "s3cret" not in repr(source)
    assert "s3cret" not in repr(RelationalSource("jdbc:s3cret", table="t"))
    assert json.dumps(page([1], None))


def test_small_tables_do_not_grow_by_a_file_a_row(spark, scratch):
    from millrace import Table
    from millrace.sinks.datasets import DatasetStore, Lifecycle

    store = CheckpointStore(spark, f"{scratch}/c")
    for value in (1, 2, {"a": [3]}):
        assert store.commit("p", "s", value, "r", "succeeded")
    store.commit("p", "other", "x", "r", "succeeded")
    assert store.load("p", "s") == {"a": [3]} and store.load("p", "other") == "x" and store.load("q", "s") is None
    assert store.table().count() == 2

    datasets = DatasetStore(spark, f"{scratch}/d")
    kept = [datasets.persist(Table.of(spark.range(n)), Lifecycle("p", f"r{n}")) for n in range(3)]
    before = sorted(map(tuple, datasets.manifest().collect()))
    assert datasets.compact() == 3 and datasets.compact() == 1
    assert sorted(map(tuple, datasets.manifest().collect())) == before
    assert datasets.table(kept[2].id).frame().count() == 2
