"""Source checkpoints: one durable JSON value per pipeline and source.

The store has a folder per key with numbered files of one JSON row; the greatest number
holds.  A number is created exclusively, so of two writers one has to look again and no
writer removes what another has just written.  A value is committed after its run
succeeded, so a failed run reads the same rows again.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from ..sinks import storage

CHECKPOINTS = "pipeline_id string, source_id string, checkpoint string, run_id string, updated_at timestamp"
SUCCESSFUL = ("succeeded", "completed_with_warnings")
ATTEMPTS = 20


def checked_json(value: Any) -> str:
    """The JSON text of a checkpoint value; NaN and foreign types are errors."""

    def finite(v: Any) -> bool:
        if isinstance(v, float):
            return math.isfinite(v)
        if isinstance(v, dict):
            return all(isinstance(k, str) and finite(x) for k, x in v.items())
        if isinstance(v, list):
            return all(finite(x) for x in v)
        return v is None or isinstance(v, str | int | bool)

    if not finite(value):
        raise DataError("A checkpoint must be a JSON value.")
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class CheckpointStore:
    """Checkpoints in a table of the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def table(self) -> DataFrame:
        """The latest row of every key."""
        if not storage.exists(self.spark, self.path):
            return self.spark.createDataFrame([], CHECKPOINTS)
        files = self.spark.read.option("recursiveFileLookup", True).option("mode", "DROPMALFORMED")
        rows = files.schema(CHECKPOINTS).json(self.path).where("pipeline_id IS NOT NULL AND source_id IS NOT NULL")
        names = ("checkpoint", "run_id", "updated_at")
        last = F.max_by(F.struct(*names), "_metadata.file_name").alias("last")
        latest = rows.groupBy("pipeline_id", "source_id").agg(last)
        return latest.select("pipeline_id", "source_id", *[f"last.{n}" for n in names])

    def _folder(self, pipeline_id: str, source_id: str) -> str:
        name = hashlib.sha256(json.dumps([pipeline_id, source_id]).encode()).hexdigest()
        return f"{self.path}/{name[:32]}"

    def _numbers(self, folder: str) -> list[int]:
        return [int(f.rsplit("/", 1)[1]) for f in storage.visible_files(self.spark, folder)]

    def position(self, pipeline_id: str, source_id: str) -> tuple[int, Any]:
        """The number and the value committed last; 0 and None if there is none."""
        folder = self._folder(pipeline_id, source_id)
        for _ in range(ATTEMPTS):
            numbers = self._numbers(folder)
            try:
                for number in reversed(numbers):
                    row = _row(storage.read_text(self.spark, _file(folder, number)))
                    if row is not None:
                        return number, json.loads(row["checkpoint"])
                return 0, None
            except Exception:
                # A writer may have removed it in between; its successor is there then.
                if storage.exists(self.spark, _file(folder, number)):
                    raise
        raise DataError("The checkpoint is written to by too many others.")

    def load(self, pipeline_id: str, source_id: str) -> Any:
        """The latest committed value of a source, or None."""
        return self.position(pipeline_id, source_id)[1]

    def commit(
        self, pipeline_id: str, source_id: str, value: Any, run_id: str, state: str, after: int | None = None
    ) -> bool:
        """Store the value of a run that succeeded; others change nothing.

        With `after`, the number `position` gave, the value is stored only if no other
        has been stored since; else it follows whatever is there.
        """
        if state not in SUCCESSFUL:
            return False
        row = {
            "pipeline_id": pipeline_id,
            "source_id": source_id,
            "checkpoint": checked_json(value),
            "run_id": run_id,
            "updated_at": datetime.now(UTC).isoformat(),
        }
        folder, text = self._folder(pipeline_id, source_id), json.dumps(row)
        for _ in range(ATTEMPTS):
            numbers = self._numbers(folder)
            number = max(numbers, default=0) + 1
            if after is not None and number != after + 1:
                return False
            if storage.create_text(self.spark, _file(folder, number), text):
                # The file before stays: a writer that looked before this one finds its number taken.
                for old in numbers:
                    if old < number - 1:
                        storage.remove(self.spark, _file(folder, old))
                return True
            # A number whose writer was lost is taken all the same; the next look counts it.
        raise DataError("The checkpoint is written to by too many others.")


def _file(folder: str, number: int) -> str:
    return f"{folder}/{number:020d}"


def _row(text: str) -> dict[str, Any] | None:
    """The row of a file, or none if its writer was lost before the end."""
    try:
        return json.loads(text)
    except ValueError:
        return None


def run_with_checkpoint(
    store: CheckpointStore,
    key: tuple[str, str],
    run_id: str,
    work: Callable[[Any], Any],
    record_run: Callable[[str], None] = lambda state: None,
) -> Any:
    """Work from the value stored under `key` (pipeline, source), and store the next one.

    `work` takes the value, delivers its output and returns the next value or None.
    Until the run is recorded the next value exists only here, so a run that fails
    leaves nothing behind; if storing it fails, the run stays successful and its rows
    are read once more.
    """
    try:
        following = work(store.load(*key))
        if following is not None:
            checked_json(following)
    except Exception:
        record_run("failed")
        raise
    record_run("succeeded")
    if following is not None:
        store.commit(*key, following, run_id, "succeeded")
    return following
