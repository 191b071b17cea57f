"""Pipelines: one source, transforms and one sink as one lazy plan with one action."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import build, under_root
from ..errors import ConfigError
from ..history import METRICS, checked_metrics
from ..session import scratch_path
from ..operators.flatten import FlattenDocument
from ..operators.rows import LimitRows
from ..sinks import storage
from ..sinks.artifacts import Artifact, ArtifactStore
from ..sinks.datasets import Lifecycle, append_row, append_rows
from ..sinks.relational import RelationalSink, Target
from ..sources.dataset import stored
from ..sources.documents import JsonSource
from ..sources.pages import PagedSource, Transport
from ..sources.relational import Database, RelationalSource
from ..streaming.checkpoints import CheckpointStore, run_with_checkpoint
from ..table import Documents, Table
from .catalog import Component, component

EVENTS = "run_id string, step string, state string, recorded_at timestamp, " + ", ".join(
    f"{name} bigint" for name in METRICS
)
RUNS = "id string, pipeline_id string, state string, finished_at timestamp"


@dataclass(frozen=True)
class Context:
    """What the steps of a run need besides their configuration.

    `input_root` and `output_root` are folders every executor reaches.  `measure`
    is `sink` for the rows written, or `all` for the rows of every step.  Counting
    between steps keeps Catalyst from moving filters across the counted place, and
    writes the table once more before it is sorted.
    """

    spark: SparkSession
    input_root: str
    output_root: str
    pipeline_id: str = "pipeline"
    database: Database | None = None
    target: Target | None = None
    transport: Transport | None = None
    checkpoints: CheckpointStore | None = None
    resolve_secret: Callable[[str], str] | None = None
    measure: str = "sink"


@dataclass(frozen=True)
class Step:
    name: str
    component: Component
    operator: Any


@dataclass(frozen=True)
class RunResult:
    run_id: str
    artifact: Artifact | None
    checkpoint: Any
    metrics: dict[str, dict[str, int | None]] = field(default_factory=dict)


@dataclass(frozen=True)
class Pipeline:
    """Validated steps; nothing is read before `plan` or `run`."""

    steps: tuple[Step, ...]

    @classmethod
    def of(
        cls,
        steps: Sequence[Mapping[str, Any]],
        resolve_secret: Callable[[str], str] | None = None,
    ) -> "Pipeline":
        """Steps are `{type, version?, config?, secrets?}`; `secrets` maps a secret
        field to the name of its binding."""
        built = []
        for number, step in enumerate(steps):
            if not isinstance(step, Mapping) or set(step) - {"type", "version", "config", "secrets"}:
                raise ConfigError(f"Step {number} has unknown entries.")
            if "type" not in step:
                raise ConfigError(f"Step {number} has no type.")
            part = component(step["type"], step.get("version", "v1"))
            secrets = {}
            for key, binding in (step.get("secrets") or {}).items():
                if resolve_secret is None:
                    raise ConfigError("Secret bindings need a resolver.")
                secrets[key] = resolve_secret(binding)
                if not secrets[key]:
                    raise ConfigError(f"The secret {key} could not be resolved.")
            operator = build(part.config, step.get("config") or {}, secrets)
            built.append(Step(f"{number}:{step['type']}", part, operator))
        _require_line(built)
        return cls(tuple(built))

    def plan(self, context: Context) -> Table:
        """The table the sink would receive, lazily."""
        loaded = self._load(context, None)[0]
        return self._transformed(context, loaded, {})

    def run(self, context: Context, run_id: str | None = None, attempt: int = 0) -> RunResult:
        """Deliver the table, record the run, then commit the source checkpoint.

        `attempt` numbers the repetitions of a run that the caller retries.
        """
        run_id = run_id or uuid.uuid4().hex
        source = self.steps[0]
        observed: dict[str, Observation] = {}
        delivered: dict[str, Any] = {}
        started = time.monotonic()

        def work(checkpoint: Any) -> Any:
            loaded, candidate = self._load(context, checkpoint)
            table = self._transformed(context, loaded, observed)
            delivered["artifact"] = self._deliver(context, table, run_id, observed)
            return candidate

        def record_run(state: str) -> None:
            row = (run_id, context.pipeline_id, state, datetime.now(UTC))
            names = ("id", "pipeline_id", "state", "finished_at")
            path = f"{context.output_root}/history/runs"
            append_row(context.spark, path, dict(zip(names, row)), RUNS)

        if _incremental(source.operator) and context.checkpoints is not None:
            key = (context.pipeline_id, source.name)
            candidate = run_with_checkpoint(context.checkpoints, key, run_id, work, record_run)
        else:
            try:
                candidate = work(None)
            except Exception:
                record_run("failed")
                raise
            record_run("succeeded")
        duration = int((time.monotonic() - started) * 1000)
        artifact = delivered.get("artifact")
        metrics = self._metrics(context, observed, artifact)
        metrics[self.steps[-1].name] |= {"duration_ms": duration, "retry_attempt": attempt}
        self._record_events(context, run_id, metrics)
        return RunResult(run_id, artifact, candidate, metrics)

    def _load(self, context: Context, checkpoint: Any) -> tuple[Table | Documents, Any]:
        """The source, and the checkpoint candidate of an incremental one.

        An incremental extraction is written to the shared folder first: the rows
        delivered and the candidate then stem from the same read.
        """
        spark, source = context.spark, self.steps[0].operator
        if isinstance(source, RelationalSource):
            table = source(spark, context.database, checkpoint)
            if not (_incremental(source) and context.checkpoints):
                return table, None
            extract = stored(table, "extract")
            return extract, source.candidate(extract.df)
        if isinstance(source, PagedSource):
            pages = source(spark, context.transport, checkpoint)
            pages = pages.materialized(scratch_path(spark, "pages"))
            candidate = _page_candidate(pages) if _incremental(source) else None
            return pages.documents(), candidate
        if isinstance(source, JsonSource) and isinstance(self.steps[1].operator, FlattenDocument):
            source = replace(source, check=False)  # flatten reads every document itself
        return source(spark, context.input_root), None

    def _transformed(
        self, context: Context, loaded: Table | Documents, observed: dict[str, Observation]
    ) -> Table:
        table: Any = loaded
        for step in self.steps[:-1]:
            if context.measure == "all" and isinstance(step.operator, LimitRows):
                table = stored(table, "step")
            if step.component.kind == "transform":
                table = step.operator(table)
            if context.measure == "all" and isinstance(table, Table):
                table = replace(table, df=_counter(step.name, observed)(table.df))
        return stored(table, "step") if context.measure == "all" else table

    def _deliver(
        self, context: Context, table: Table, run_id: str, observed: dict[str, Observation]
    ) -> Artifact | None:
        step = self.steps[-1]
        table = replace(table, observe=_counter(step.name, observed))
        if isinstance(step.operator, RelationalSink):
            step.operator.write(table, run_id, context.target)
            return None
        store = ArtifactStore(context.spark, context.output_root)
        return store.publish(table, step.operator, Lifecycle(context.pipeline_id, run_id))

    def _metrics(
        self, context: Context, observed: dict[str, Observation], artifact: Artifact | None
    ) -> dict[str, dict[str, int | None]]:
        """The counters of every step; those nobody counted are left out."""
        metrics: dict[str, dict[str, int | None]] = {}
        before: int | None = None
        for step in self.steps:
            rows = observed[step.name].get["rows"] if step.name in observed else None
            metrics[step.name] = {"records_read": before, "records_written": rows}
            before = rows
        first, last = metrics[self.steps[0].name], metrics[self.steps[-1].name]
        path = getattr(self.steps[0].operator, "source_path", None)
        if path is not None:
            place = under_root(context.input_root, path)
            first["bytes_read"] = storage.matched_bytes(context.spark, place)
        last["records_read"] = last["records_written"]
        last["bytes_written"] = artifact.size_bytes if artifact else None
        return {
            name: {k: v for k, v in values.items() if v is not None}
            for name, values in metrics.items()
        }

    @staticmethod
    def _record_events(
        context: Context, run_id: str, metrics: dict[str, dict[str, int | None]]
    ) -> None:
        """One event row per step."""
        rows = []
        for step, values in metrics.items():
            row = {"run_id": run_id, "step": step, "state": "step_succeeded"}
            rows.append(row | {"recorded_at": datetime.now(UTC)} | checked_metrics(values))
        append_rows(context.spark, f"{context.output_root}/history/events", rows, EVENTS)


def _require_line(steps: list[Step]) -> None:
    kinds = [s.component.kind for s in steps]
    if len(steps) < 2 or kinds[0] != "source" or kinds[-1] != "export":
        raise ConfigError("A pipeline starts with a source and ends with an export.")
    if any(k != "transform" for k in kinds[1:-1]):
        raise ConfigError("Only transforms may stand between source and export.")
    for earlier, later in zip(steps, steps[1:]):
        if earlier.component.gives != later.component.takes:
            raise ConfigError(f"Step {later.name} does not take the output of {earlier.name}.")


def _incremental(source: Any) -> bool:
    if isinstance(source, RelationalSource):
        return source.checkpoint_column is not None
    if isinstance(source, PagedSource):
        return source.checkpoint_path is not None or source.next_page_path is not None
    return False


def _page_candidate(pages: Any) -> dict[str, Any] | None:
    last = pages.checkpoints().first()
    if last is None:
        return None
    return {"pageToken": last["pageToken"], "value": json.loads(last["value"])}


def _counter(
    name: str, observed: dict[str, Observation]
) -> Callable[[DataFrame], DataFrame]:
    """Counts the rows that pass, as a side result of the job that reads them."""

    def count(df: DataFrame) -> DataFrame:
        observed[name] = Observation(f"{name}:{uuid.uuid4().hex}")
        return df.observe(observed[name], F.count(F.lit(1)).alias("rows"))

    return count
