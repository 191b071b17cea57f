"""Published outputs: files first, then one record; no record, no files."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import DataError
from ..table import Table
from . import storage
from .datasets import Lifecycle, append_row, merge_files
from .files import CsvSink, JsonSink, ParquetSink

ARTIFACTS = (
    "id string, pipeline_id string, run_id string, format string, content_type string, "
    "file_name string, location string, size_bytes long, created_at timestamp, "
    "expires_at timestamp, retention_days int"
)
RETENTION = timedelta(days=30)


@dataclass(frozen=True)
class Artifact:
    id: str
    pipeline_id: str
    run_id: str
    format: str
    content_type: str
    file_name: str
    location: str
    size_bytes: int
    created_at: datetime
    expires_at: datetime
    retention_days: int


def kept_days(created_at: datetime, expires_at: datetime) -> int:
    """The nearest whole number of days between two moments, one at least."""
    half_days = int((expires_at - created_at).total_seconds() // 43_200)
    return max(1, (half_days + 1) // 2)


class ArtifactStore:
    """Publishes sinks below one root; `record` may replace the manifest table."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        record: Callable[[dict[str, Any]], None] | None = None,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self._record = record or self._append

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/manifest/artifacts"

    def publish(
        self, table: Table, sink: CsvSink | JsonSink | ParquetSink, lifecycle: Lifecycle
    ) -> Artifact:
        """Write the table to a location of its own, then record it.

        Spark's commit protocol hides the parts of failed tasks; a failed job or a
        failed record removes the folder.
        """
        expires_at = lifecycle.expiry(RETENTION)
        artifact_id = uuid.uuid4().hex
        location = f"{self.root}/published/{lifecycle.pipeline_id}/{artifact_id}/{sink.file_name}"
        try:
            sink.write(table, location)
            created_at = datetime.now(UTC)
            artifact = Artifact(
                id=artifact_id,
                pipeline_id=lifecycle.pipeline_id,
                run_id=lifecycle.run_id,
                format=sink.format,
                content_type=sink.content_type,
                file_name=sink.file_name,
                location=location,
                size_bytes=storage.size_bytes(self.spark, location),
                created_at=created_at,
                expires_at=expires_at,
                retention_days=kept_days(created_at, expires_at),
            )
        except Exception:
            storage.remove(self.spark, location)
            raise
        try:
            self._record(asdict(artifact))
        except Exception:
            storage.remove(self.spark, location)
            raise DataError("The artifact could not be recorded.") from None
        return artifact

    def manifest(self) -> DataFrame:
        if not storage.exists(self.spark, self.manifest_path):
            return self.spark.createDataFrame([], ARTIFACTS)
        return self.spark.read.schema(ARTIFACTS).parquet(self.manifest_path).distinct()

    def compact(self) -> int:
        """Bring the manifest, one small file per artifact, together in one."""
        return merge_files(self.spark, self.manifest_path, ARTIFACTS)

    def _append(self, row: dict[str, Any]) -> None:
        append_row(self.spark, self.manifest_path, row, ARTIFACTS)
