"""Jobs over tables of run history: retention, counts, checkpoints and metrics.

Inputs are DataFrames with the columns named in each docstring.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import whole_number
from .streaming.checkpoints import SUCCESSFUL

# Run states that never change again, job states that are counted,
# and the defaults of retention.
TERMINAL = ("succeeded", "completed_with_warnings", "failed", "cancelled")
COUNTED = ("queued", "running")
BATCH = 100
RETENTION_DAYS = 365
METRICS = (
    "bytes_read",
    "bytes_written",
    "duration_ms",
    "records_read",
    "records_written",
    "retry_attempt",
)


def _due(df: DataFrame, now: datetime) -> DataFrame:
    """Rows past their expiry; a moment without zone is UTC, like the session."""
    moment = now if now.tzinfo is not None else now.replace(tzinfo=UTC)
    limit = F.lit(moment).cast(df.schema["expires_at"].dataType)
    return df.where(F.col("expires_at") <= limit)


def _oldest(df: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return df
    return df.orderBy("expires_at", "id").limit(whole_number(limit, "limit", 1))


def _terminal(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("state").isin(*TERMINAL))


def expired_datasets(
    datasets: DataFrame, runs: DataFrame, now: datetime, limit: int | None = BATCH
) -> DataFrame:
    """Datasets `(id, run_id, expires_at, …)` past their expiry whose run has ended.

    Oldest first and bounded; `limit=None` returns all of them.  A run may own any
    share of the datasets: runs are unique, so adaptive execution can split the
    partition of such a run freely.
    """
    ended = _terminal(runs).select(F.col("id").alias("run_id"))
    return _oldest(_due(datasets, now).join(ended, "run_id", "left_semi"), limit)


def expired_records(
    records: DataFrame, now: datetime, limit: int | None = BATCH, *, terminal: bool = False
) -> DataFrame:
    """Artifacts, uploads, logs or, with `terminal`, runs past their expiry."""
    return _oldest(_due(_terminal(records) if terminal else records, now), limit)


def deletable_runs(runs: DataFrame, now: datetime, *dependents: DataFrame) -> DataFrame:
    """Ended runs past their expiry that none of the dependent tables refers to.

    Dependents are reduced to one row per run before the shuffle, so a run with most
    of the log lines weighs as much as any other.
    """
    left = _due(_terminal(runs), now)
    for dependent in dependents:
        owners = dependent.select(F.col("run_id").alias("id")).distinct()
        left = left.join(owners, "id", "left_anti")
    return left


def claim_uploads(uploads: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split uploads into those claimed by `(owner_id, location)` and the rest."""
    keys = ["owner_id", "location"]
    wanted = claims.select(*keys).distinct()
    return uploads.join(wanted, keys, "left_semi"), uploads.join(wanted, keys, "left_anti")


def state_counts(jobs: DataFrame, states: Sequence[str] = COUNTED) -> DataFrame:
    """One `(state, total)` row per state, zero when no job is in it."""
    totals = [F.count_if(F.col("state") == s) for s in states]
    pairs = [F.struct(F.lit(s).alias("state"), t.alias("total")) for s, t in zip(states, totals)]
    return jobs.agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs"))


def upsert_checkpoints(checkpoints: DataFrame, candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest `(pipeline_id, source_id, checkpoint, updated_at)` per source.

    Candidates also have a `run_id` and count only if that run of that pipeline
    succeeded.
    """
    keys = ["pipeline_id", "source_id"]
    won = runs.where(F.col("state").isin(*SUCCESSFUL)).select(F.col("id").alias("run_id"), "pipeline_id")
    accepted = candidates.join(won, ["run_id", "pipeline_id"], "left_semi")
    columns = [*keys, "checkpoint", "updated_at"]
    both = checkpoints.select(*columns, F.lit(0).alias("fresh")).unionByName(
        accepted.select(*columns, F.lit(1).alias("fresh"))
    )
    latest = F.max(F.struct("updated_at", "fresh", "checkpoint")).alias("latest")
    return (
        both.groupBy(*keys)
        .agg(latest)
        .select(*keys, F.col("latest.checkpoint").alias("checkpoint"), F.col("latest.updated_at").alias("updated_at"))
    )


def expiry(created_at: Column, days: int = RETENTION_DAYS) -> Column:
    """The moment a number of whole UTC days after creation."""
    return created_at + F.make_dt_interval(F.lit(whole_number(days, "days", 1)))


def stamp_expiry(df: DataFrame, days: int = RETENTION_DAYS) -> DataFrame:
    """Add `expires_at` to a table with `created_at`."""
    return df.withColumn("expires_at", expiry(F.col("created_at"), days))


def checked_metrics(metrics: dict[str, int | None]) -> dict[str, int | None]:
    """Aggregate counters only: known names, non-negative integers."""
    for name, value in metrics.items():
        if name not in METRICS:
            raise ValueError(f"{name} is not a metric.")
        if value is None:
            continue
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise ValueError(f"{name} must be a non-negative integer.")
    return {name: metrics.get(name) for name in METRICS}
