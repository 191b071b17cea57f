"""Retention, counts and checkpoints over history tables made from orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from millrace import history

from .registry import query

NOW = dt.datetime(1998, 1, 1)
NOW_SQL = "TIMESTAMP '1998-01-01'"


def runs(load):
    state = F.when(F.col("o_orderstatus") == "O", "running").when(
        F.col("o_orderstatus") == "F", "failed"
    )
    return load("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("pipeline_id"),
        state.otherwise("succeeded").alias("state"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
    )


RUNS = """(SELECT o_orderkey AS id, o_custkey AS pipeline_id, CASE o_orderstatus WHEN 'O' THEN 'running'
  WHEN 'F' THEN 'failed' ELSE 'succeeded' END AS state, o_orderdate + INTERVAL 30 DAYS AS expires_at FROM orders)"""


def datasets(load):
    return load("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_shipdate") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"),
    )


DATASETS = """(SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey AS run_id,
  l_shipdate + INTERVAL 10 DAYS AS expires_at FROM lineitem)"""


def logs(load):
    return load("events").select(F.col("event_id").alias("id"), (F.col("event_id") * 3).alias("run_id"))


LOGS = "(SELECT event_id AS id, event_id * 3 AS run_id FROM events)"

EXPIRED = f"""SELECT d.run_id, d.id, d.expires_at FROM {DATASETS} d JOIN {RUNS} r ON d.run_id = r.id
  WHERE d.expires_at <= {NOW_SQL} AND r.state IN ('succeeded', 'failed')"""


@query("run_expired_datasets", f"{EXPIRED} ORDER BY d.expires_at, d.id, d.run_id LIMIT 100")
def run_expired_datasets(load, spark):
    return history.expired_datasets(datasets(load), runs(load), NOW)


@query("run_expired_datasets_all", EXPIRED)
def run_expired_datasets_all(load, spark):
    return history.expired_datasets(datasets(load), runs(load), NOW, limit=None)


@query(
    "run_expired_records",
    f"SELECT * FROM {RUNS} WHERE expires_at <= {NOW_SQL} AND state <> 'running' ORDER BY expires_at, id LIMIT 100",
)
def run_expired_records(load, spark):
    return history.expired_records(runs(load), NOW, terminal=True)


@query("run_expired_uploads", f"SELECT id, expires_at FROM {DATASETS} WHERE expires_at <= {NOW_SQL}")
def run_expired_uploads(load, spark):
    return history.expired_records(datasets(load).select("id", "expires_at"), NOW, limit=None)


@query(
    "run_deletable",
    f"""SELECT * FROM {RUNS} r WHERE expires_at <= {NOW_SQL} AND state <> 'running'
        AND NOT EXISTS (SELECT 1 FROM {LOGS} l WHERE l.run_id = r.id)
        AND NOT EXISTS (SELECT 1 FROM {DATASETS} d WHERE d.run_id = r.id AND d.expires_at > {NOW_SQL})""",
)
def run_deletable(load, spark):
    kept = datasets(load).where(F.col("expires_at") > F.lit("1998-01-01").cast("timestamp_ntz"))
    return history.deletable_runs(runs(load), NOW, logs(load), kept)


@query(
    "run_expired_runs_all",
    f"SELECT * FROM {RUNS} WHERE expires_at <= {NOW_SQL} AND state <> 'running'",
)
def run_expired_runs_all(load, spark):
    return history.expired_records(runs(load), NOW, limit=None, terminal=True)


@query(
    "run_deletable_unowned",
    f"""SELECT * FROM {RUNS} r WHERE expires_at <= {NOW_SQL} AND state <> 'running'
        AND id NOT IN (SELECT run_id FROM {LOGS} WHERE run_id IS NOT NULL)
        AND id NOT IN (SELECT run_id FROM {DATASETS} WHERE run_id IS NOT NULL)
        AND id NOT IN (SELECT conv_id FROM conversations)""",
)
def run_deletable_unowned(load, spark):
    """Three dependent tables, none of them filtered."""
    talks = load("conversations").select(F.col("conv_id").alias("run_id"))
    return history.deletable_runs(runs(load), NOW, logs(load), datasets(load), talks)


@query(
    "run_claims",
    """SELECT event_id, user_id AS owner_id, event_type AS location,
       EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.user_id AND e.event_type IN ('click', 'view')) AS claimed
       FROM events e""",
)
def run_claims(load, spark):
    uploads = load("events").select(
        "event_id", F.col("user_id").alias("owner_id"), F.col("event_type").alias("location")
    )
    places = F.explode(F.array(F.lit("click"), F.lit("view"))).alias("location")
    claims = load("labels").select(F.col("doc_id").alias("owner_id"), places)
    claimed, remaining = history.claim_uploads(uploads, claims)
    both = claimed.withColumn("claimed", F.lit(True)).unionByName(
        remaining.withColumn("claimed", F.lit(False))
    )
    return both.select("event_id", "owner_id", "location", "claimed")


@query(
    "run_state_counts",
    f"""SELECT 'running' AS state, count(*) FILTER (WHERE state = 'running') AS total FROM {RUNS}
        UNION ALL SELECT 'queued', 0 UNION ALL SELECT 'failed', count(*) FILTER (WHERE state = 'failed') FROM {RUNS}""",
)
def run_state_counts(load, spark):
    return history.state_counts(runs(load), ("queued", "running", "failed"))


@query(
    "run_checkpoint_upsert",
    f"""SELECT pipeline_id, source_id, checkpoint, updated_at FROM (
          SELECT c_custkey AS pipeline_id, 'a' AS source_id, 'old' AS checkpoint,
                 TIMESTAMP '1996-01-01' AS updated_at, 0 AS fresh FROM customer
          UNION ALL
          SELECT r.pipeline_id, CASE WHEN r.id % 2 = 0 THEN 'a' ELSE 'b' END, 'run ' || r.id, r.expires_at, 1
          FROM {RUNS} r WHERE r.state = 'succeeded')
        QUALIFY row_number() OVER (PARTITION BY pipeline_id, source_id
                                   ORDER BY updated_at DESC, fresh DESC, checkpoint DESC) = 1""",
)
def run_checkpoint_upsert(load, spark):
    stored = load("customer").select(
        F.col("c_custkey").alias("pipeline_id"), F.lit("a").alias("source_id"),
        F.lit("old").alias("checkpoint"), F.expr("TIMESTAMP_NTZ'1996-01-01'").alias("updated_at"),
    )
    candidates = runs(load).select(
        "pipeline_id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source_id"),
        F.concat(F.lit("run "), F.col("id").cast("string")).alias("checkpoint"),
        F.col("expires_at").alias("updated_at"), F.col("id").alias("run_id"),
    )
    return history.upsert_checkpoints(stored, candidates, runs(load))


@query(
    "run_expiry_stamp",
    "SELECT event_id AS id, ts AS created_at, ts + INTERVAL 365 DAYS AS expires_at FROM events",
)
def run_expiry_stamp(load, spark):
    return history.stamp_expiry(load("events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at")))
