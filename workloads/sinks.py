"""Sinks, incremental runs and whole pipelines, checked by reading back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import Documents, FlattenDocument, SortRows, Table
from millrace.plans.pipeline import Context, Pipeline
from millrace.session import scratch_path
from millrace.sinks.artifacts import ArtifactStore
from millrace.sinks.datasets import DatasetStore, Lifecycle
from millrace.sinks.files import CsvSink, JsonSink, ParquetSink
from millrace.sinks.relational import FolderTarget, RelationalSink
from millrace.sinks.snapshots import SnapshotTarget
from millrace.sources.dataset import scan
from millrace.sources.documents import JsonSource
from millrace.sources.relational import CatalogDatabase
from millrace.streaming.checkpoints import CheckpointStore, run_with_checkpoint
from millrace.streaming.files import run_new_files

from .registry import ordered, query

# -- files and datasets ------------------------------------------------------------


@query("snk_json", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer")
def snk_json(load, spark):
    root = scratch_path(spark, "json")
    df = load("customer").drop("c_mktsegment")
    JsonSink("customer.json").write(Table.of(df), f"{root}/customer")
    lines = JsonSource("customer", layout="lines", check=False)(spark, root)
    return FlattenDocument()(lines).frame()


@query("snk_parquet", "SELECT * FROM lineitem")
def snk_parquet(load, spark):
    path = scratch_path(spark, "parquet")
    ParquetSink("lineitem.parquet").write(Table.of(load("lineitem")), path)
    return spark.read.parquet(path)


@query(
    "snk_parquet_ordered",
    "SELECT *, lag(o_orderkey) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS earlier FROM orders",
)
def snk_parquet_ordered(load, spark):
    """Every row with the row that the sorted file holds before it."""
    path = scratch_path(spark, "parquet")
    keys = [{"column": "o_totalprice", "descending": True}]
    ParquetSink("o.parquet").write(SortRows(keys)(ordered(load("orders"), "o_orderkey")), path)
    rows = scan(spark, path)
    part, _, row = (k.column for k in rows.order)
    before = rows.df.select(part, (F.col(row) + 1).alias(row), F.col("o_orderkey").alias("earlier"))
    # The first row of a file follows the last row of the one before it: one number
    # per file, which comes back as a local relation.
    last = sorted(rows.df.groupBy(part).agg(F.max_by("o_orderkey", row)).collect())
    carried = [(n, key) for (n, _), (_, key) in zip(last, [(None, None), *last])]
    files = spark.createDataFrame(carried, f"{part} int, carried bigint")
    earlier = F.when(F.col(row) == 0, F.col("carried")).otherwise(F.col("earlier"))
    return (
        rows.df.join(before, [part, row], "left")
        .join(files, part)
        .withColumn("earlier", earlier)
        .select(*rows.columns, "earlier")
    )


@query("snk_batches", "SELECT event_id, user_id::DOUBLE AS user_id, event_type FROM events")
def snk_batches(load, spark):
    """Batches of other types and column orders take the schema of the first."""
    events = load("events").select("event_id", F.col("user_id").cast("double"), "event_type")
    frames = [
        events.where("user_id < 50"),
        events.where("user_id >= 50 AND user_id < 100").selectExpr(
            "event_type", "CAST(user_id AS INT) AS user_id", "event_id"
        ),
        events.where("user_id >= 100"),
    ]
    store = DatasetStore(spark, scratch_path(spark, "store"))
    return store.table(store.persist_batches(frames, Lifecycle("events", "run"))).frame()


@query("snk_documents", "SELECT conv_id, turn, text FROM conversations")
def snk_documents(load, spark):
    body = F.to_json(F.struct("conv_id", "turn", "text"))
    df = load("conversations").select("conv_id", "turn", body.alias("body"))
    store = DatasetStore(spark, scratch_path(spark, "store"))
    saved = store.persist_documents(
        Documents.of(df, "body", ["conv_id", "turn"]), Lifecycle("conversations", "run")
    )
    return FlattenDocument()(store.documents(saved.id)).frame()


@query(
    "snk_publish",
    """SELECT c_custkey, c_name, 'customer.csv' AS file_name, 'csv' AS format, 'text/csv' AS content_type,
       30 AS retention_days, true AS sized FROM customer""",
)
def snk_publish(load, spark):
    """The rows of the published file next to its manifest row."""
    store = ArtifactStore(spark, scratch_path(spark, "artifacts"))
    table = Table.of(load("customer").select("c_custkey", "c_name"))
    artifact = store.publish(table, CsvSink("customer.csv"), Lifecycle("customer", "run"))
    rows = spark.read.schema("c_custkey bigint, c_name string").csv(artifact.location, header=True)
    record = store.manifest().where(F.col("id") == artifact.id).first()
    names = ("file_name", "format", "content_type", "retention_days")
    noted = [F.lit(record[n]).alias(n) for n in names]
    return rows.select("*", *noted, F.lit(record["size_bytes"] > 0).alias("sized"))


# -- tables ------------------------------------------------------------------------


@query("snk_replace", "SELECT * FROM supplier WHERE s_acctbal > 0")
def snk_replace(load, spark):
    target = FolderTarget(scratch_path(spark, "tables"), {})
    sink = RelationalSink("supplier")
    sink.write(Table.of(load("supplier")), "run1", target)
    sink.write(Table.of(load("supplier").where("s_acctbal > 0")), "run2", target)
    return spark.read.parquet(target.path("supplier"))


@query(
    "snk_append_idempotent",
    "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
)
def snk_append_idempotent(load, spark):
    """The same load twice, with conflicts inside it, adds each key once."""
    target = FolderTarget(scratch_path(spark, "tables"), {"events": ["user_id", "event_type"]})
    sink = RelationalSink("events", "append")
    table = ordered(load("events"), "event_id")
    sink.write(table, "run1", target)
    sink.write(table, "run1", target)
    return spark.read.parquet(target.path("events"))


@query("snk_snapshot_replace", "SELECT * FROM supplier WHERE s_acctbal > 0")
def snk_snapshot_replace(load, spark):
    """A replaced table of numbered snapshots."""
    target = SnapshotTarget(scratch_path(spark, "tables"), {})
    RelationalSink("supplier").write(Table.of(load("supplier")), "run1", target)
    RelationalSink("supplier").write(Table.of(load("supplier").where("s_acctbal > 0")), "run2", target)
    return target.read(spark, "supplier")


@query("snk_snapshot_append", "SELECT * FROM orders")
def snk_snapshot_append(load, spark):
    """Three loads that overlap; each is compared with the parts its keys can be in."""
    target = SnapshotTarget(scratch_path(spark, "tables"), {"orders": ["o_orderkey"]})
    middle = load("orders").agg(F.floor(F.avg("o_orderkey"))).first()[0]
    for run, rows in enumerate(("o_orderkey <= {}", "o_orderkey > {} - 1000", "true")):
        table = ordered(load("orders").where(rows.format(middle)), "o_orderkey")
        RelationalSink("orders", "append").write(table, f"run{run}", target)
    return target.read(spark, "orders")


# -- incremental runs --------------------------------------------------------------


def _delivery(load, spark, fail: bool):
    """Two incremental runs of events into a table; the second may fail once."""
    view = f"millrace_runs_{fail}".lower()
    store = CheckpointStore(spark, scratch_path(spark, "checkpoints"))
    target = FolderTarget(scratch_path(spark, "tables"), {"events": ["event_id"]})
    steps = [
        {"type": "source.postgres", "config": {"table": view, "checkpointColumn": "event_id"}},
        {"type": "transform.columns.drop", "config": {"columns": ["props"]}},
        {"type": "export.postgres", "config": {"targetTable": "events", "writeMode": "append"}},
    ]
    pipeline = Pipeline.of(steps)
    context = Context(
        spark, "", scratch_path(spark, "runs"),
        database=CatalogDatabase(), target=target, checkpoints=store,
    )
    middle = load("events").agg(F.floor(F.avg("event_id"))).first()[0]
    load("events").where(F.col("event_id") <= middle).createOrReplaceTempView(view)
    first = pipeline.run(context, "run1")
    load("events").createOrReplaceTempView(view)
    if fail:
        try:
            pipeline.run(_with_broken_target(context, target), "run2")
        except OSError:
            pass
    second = pipeline.run(context, "run3")
    stored = store.load(context.pipeline_id, pipeline.steps[0].name)
    rows = spark.read.parquet(target.path("events"))
    return rows.select(
        "event_id", "user_id", "value",
        F.when(F.col("event_id") <= first.checkpoint["value"], 1).otherwise(2).alias("run"),
        F.lit(stored["value"] == second.checkpoint["value"]).alias("committed"),
        F.lit(stored["value"]).alias("checkpoint"),
    )


class _BrokenTarget:
    """Delivers everything and then fails, like a connection lost before its answer."""

    def __init__(self, target) -> None:
        self.target = target

    def deliver(self, *arguments) -> None:
        self.target.deliver(*arguments)
        raise OSError("connection lost")


def _with_broken_target(context: Context, target) -> Context:
    from dataclasses import replace

    return replace(context, target=_BrokenTarget(target))


DELIVERED = """SELECT event_id, user_id, value,
  CASE WHEN event_id <= (SELECT floor(avg(event_id)) FROM events) THEN 1 ELSE 2 END AS run,
  true AS committed, (SELECT max(event_id) FROM events) AS checkpoint FROM events"""


@query("inc_commit", DELIVERED)
def inc_commit(load, spark):
    return _delivery(load, spark, fail=False)


@query("inc_discard", DELIVERED)
def inc_discard(load, spark):
    """A run that fails after delivery changes no checkpoint; its repeat adds nothing."""
    return _delivery(load, spark, fail=True)


@query(
    "inc_lifecycle",
    """SELECT n AS run, m AS loaded FROM (VALUES (1, NULL), (2, 0), (3, 0), (4, 2)) AS v(n, d)
       LEFT JOIN (SELECT max(event_id) AS m, 0 AS k FROM events WHERE user_id < 50
                  UNION ALL SELECT max(event_id), 2 FROM events WHERE user_id < 100) ON k = d""",
)
def inc_lifecycle(load, spark):
    """What four runs load when the second fails: nothing, one value twice, the next."""
    store = CheckpointStore(spark, scratch_path(spark, "checkpoints"))
    loaded = []

    def work(bound, fail):
        def step(checkpoint):
            loaded.append((len(loaded) + 1, checkpoint))
            value = load("events").where(F.col("user_id") < bound).agg(F.max("event_id")).first()[0]
            if fail:
                raise OSError("lost")
            return value

        return step

    for number, (bound, fail) in enumerate([(50, False), (100, True), (100, False), (150, False)]):
        try:
            run_with_checkpoint(store, ("pipe", "source"), f"run{number}", work(bound, fail))
        except OSError:
            pass
    return spark.createDataFrame(loaded, "run int, loaded bigint")


@query("stream_files", "SELECT event_id, user_id, lower(event_type) AS event_type, value FROM events")
def stream_files(load, spark):
    """Files arrive between two incremental runs; every row is written once."""
    from millrace import NormalizeText, SelectColumns

    source, out, state = (scratch_path(spark, n) for n in ("arrivals", "stream", "state"))
    events = load("events")

    def transform(table):
        kept = SelectColumns(["event_id", "user_id", "event_type", "value"])(table)
        return NormalizeText("event_type", "lowercase")(kept)

    for part in ("user_id < 75", "user_id >= 75"):
        events.where(part).write.mode("append").parquet(source)
        run_new_files(spark, source, events.schema, out, state, transform)
    return scan(spark, out, batch="__batch").frame()


# -- pipelines ---------------------------------------------------------------------


def _input_csv(load, spark):
    root = scratch_path(spark, "inputs")
    df = load("orders").select(
        "o_orderkey", "o_custkey", F.lower("o_orderpriority").alias("o_orderpriority"),
        "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    CsvSink("orders.csv").write(Table.of(df), f"{root}/orders.csv")
    return root


LINEAR = [
    {"type": "source.csv", "version": "v1", "config": {"sourcePath": "orders.csv"}},
    {"type": "transform.rows.filter", "config": {"column": "o_totalprice", "operator": "greaterThan", "value": 1000}},
    {"type": "transform.values.fill-null", "config": {"column": "o_orderstatus", "value": "open"}},
    {"type": "transform.values.normalize-string", "config": {"column": "o_orderpriority", "operation": "uppercase"}},
    {"type": "transform.values.replace", "config": {"column": "o_orderstatus", "replacements": {"O": "ordered"}}},
    {"type": "transform.columns.rename", "config": {"renames": {"o_orderkey": "order", "o_orderstatus": "status"}}},
    {"type": "transform.rows.sort", "config": {"columns": [{"column": "o_totalprice", "descending": True}]}},
    {"type": "transform.rows.deduplicate", "config": {"columns": ["o_custkey"], "keep": "first"}},
    {"type": "transform.values.cast", "config": {"column": "order", "data_type": "text"}},
    {"type": "transform.columns.reorder", "config": {"columns": ["status", "order"]}},
    {"type": "transform.columns.drop", "config": {"columns": ["o_custkey"]}},
    {"type": "export.parquet", "config": {"fileName": "orders.parquet"}},
]

LINEAR_SQL = """SELECT CASE o_orderstatus WHEN 'O' THEN 'ordered' WHEN 'P' THEN 'open' ELSE o_orderstatus END
  AS status, o_orderkey::VARCHAR AS "order", o_orderpriority, o_totalprice FROM orders
  WHERE o_totalprice > 1000
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"""


@query("pipe_linear", LINEAR_SQL)
def pipe_linear(load, spark):
    context = Context(spark, _input_csv(load, spark), scratch_path(spark, "outputs"))
    result = Pipeline.of(LINEAR).run(context)
    return spark.read.parquet(result.artifact.location)


def _step_counts() -> str:
    """How many rows leave each step of the linear pipeline."""
    sizes = {
        "read": "SELECT count(*) FROM orders",
        "filtered": "SELECT count(*) FROM orders WHERE o_totalprice > 1000",
        "deduplicated": f"SELECT count(*) FROM ({LINEAR_SQL})",
    }
    rows = []
    for number, step in enumerate(LINEAR):
        size = "read" if number < 1 else "filtered" if number < 7 else "deduplicated"
        rows.append(f"SELECT '{number}:{step['type']}' AS step, ({sizes[size]}) AS records_written")
    return " UNION ALL ".join(rows)


@query("run_step_metrics", _step_counts())
def run_step_metrics(load, spark):
    """The event rows the run of a pipeline leaves behind, one per step."""
    context = Context(spark, _input_csv(load, spark), scratch_path(spark, "outputs"), measure="all")
    Pipeline.of(LINEAR).run(context)
    events = spark.read.parquet(f"{context.output_root}/history/events")
    return events.select("step", F.col("records_written").cast("bigint").alias("records_written"))


@query("pipe_json", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def pipe_json(load, spark):
    """One pipeline exports JSON arrays, another reads them back."""
    root = scratch_path(spark, "inputs")
    CsvSink("o.csv").write(Table.of(load("orders").drop("o_orderdate", "o_orderpriority")), f"{root}/o.csv")
    export = {"type": "export.json", "config": {"fileName": "o.json", "rowsPerArray": 3000}}
    first = Pipeline.of([{"type": "source.csv", "config": {"sourcePath": "o.csv"}}, export])
    middle = scratch_path(spark, "outputs")
    artifact = first.run(Context(spark, root, middle)).artifact
    folder = artifact.location.split(f"{middle.rsplit('/', 1)[1]}/", 1)[1]
    second = Pipeline.of([
        {"type": "source.json", "config": {"sourcePath": folder}},
        {"type": "transform.document.flatten", "config": {}},
        {"type": "export.parquet", "config": {"fileName": "o.parquet"}},
    ])
    result = second.run(Context(spark, middle, scratch_path(spark, "outputs")))
    return spark.read.parquet(result.artifact.location)


@query(
    "pipe_documents",
    """SELECT conv_id, turn, role FROM conversations WHERE role <> 'system'""",
)
def pipe_documents(load, spark):
    root = scratch_path(spark, "inputs")
    df = load("conversations").select("conv_id", F.struct("turn", "role").alias("said"))
    JsonSink("c.json").write(Table.of(df), f"{root}/c.json")
    steps = [
        {"type": "source.json", "config": {"sourcePath": "c.json"}},
        {"type": "transform.document.flatten", "config": {"array_mode": "explode"}},
        {"type": "transform.rows.filter", "config": {"column": "said.role", "operator": "notEquals", "value": "system"}},
        {"type": "transform.columns.rename", "config": {"renames": {"said.turn": "turn", "said.role": "role"}}},
        {"type": "export.parquet", "config": {"fileName": "turns.parquet"}},
    ]
    context = Context(spark, root, scratch_path(spark, "outputs"))
    return spark.read.parquet(Pipeline.of(steps).run(context).artifact.location)
