"""Persisted datasets: Parquet or document folders with a manifest row each.

The manifest is an append-only table.  Its row is written after the data, so a
dataset exists for readers only once it is complete.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError, SchemaError
from ..session import small_frame
from ..sources.dataset import in_file_order
from ..sources.documents import compact
from ..table import HIDDEN, Documents, OrderKey, Table, col
from . import storage

MANIFEST = (
    "id string, family string, format string, location string, structure string, row_order string, "
    "pipeline_id string, run_id string, step_id string, created_at timestamp, expires_at timestamp"
)
BATCH = "__batch"


@dataclass(frozen=True)
class Lifecycle:
    """Who owns an output and until when it is kept."""

    pipeline_id: str
    run_id: str
    step_id: str | None = None
    expires_at: datetime | None = None

    def expiry(self, default: timedelta) -> datetime:
        moment = self.expires_at or datetime.now(UTC) + default
        if moment.tzinfo is None:
            raise ValueError("An expiry needs a time zone.")
        if moment <= datetime.now(UTC):
            raise ValueError("An expiry must lie in the future.")
        return moment


@dataclass(frozen=True)
class Descriptor:
    """One manifest row."""

    id: str
    family: str
    format: str
    location: str
    structure: str
    row_order: str
    pipeline_id: str
    run_id: str
    step_id: str | None
    created_at: datetime
    expires_at: datetime


def structure_of(schema: T.StructType) -> str:
    """Names, types and nullability of the columns, as stored in the manifest."""
    return json.dumps([[f.name, f.dataType.simpleString(), f.nullable] for f in schema])


def append_row(spark: SparkSession, path: str, row: dict[str, Any], schema: str) -> None:
    """Append one record to a small table."""
    append_rows(spark, path, [row], schema)


def append_rows(spark: SparkSession, path: str, rows: list[dict[str, Any]], schema: str) -> None:
    names = T.StructType.fromDDL(schema).names
    records = small_frame(spark, [tuple(row[n] for n in names) for row in rows], schema)
    records.coalesce(1).write.mode("append").parquet(path)


def merge_files(spark: SparkSession, path: str, schema: str) -> int:
    """Bring the files of an append-only table together; returns how many there were.

    Rows are written anew before their old files go, so a reader may see some twice,
    never none: readers take distinct rows.  Files that come meanwhile are left alone.
    """
    old = storage.visible_files(spark, path)
    if len(old) > 1:
        spark.read.schema(schema).parquet(*old).distinct().coalesce(1).write.mode("append").parquet(path)
        for file in old:
            storage.remove(spark, file)
    return len(old)


class DatasetStore:
    """Datasets below one root that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, retention: timedelta = timedelta(days=1)):
        if retention <= timedelta():
            raise ValueError("The retention of datasets must be positive.")
        self.spark = spark
        self.root = root.rstrip("/")
        self.retention = retention

    @property
    def manifest_path(self) -> str:
        return f"{self.root}/manifest/datasets"

    def persist(self, table: Table, lifecycle: Lifecycle) -> Descriptor:
        """Write a table once, with its order columns instead of a global sort."""
        location = self._location(lifecycle)
        keys = [k.column for k in table.order]
        df = table.df.select(*[col(c) for c in table.columns], *keys)
        df.write.mode("errorifexists").option("compression", "zstd").parquet(location)
        order = json.dumps([[k.column, k.descending] for k in table.order])
        return self._record(
            "tabular", "parquet", location, structure_of(table.schema), lifecycle, order
        )

    def persist_batches(self, frames: Iterable[DataFrame], lifecycle: Lifecycle) -> Descriptor:
        """Write frames one after another with the schema of the first."""
        location = self._location(lifecycle)
        schema: T.StructType | None = None
        for number, frame in enumerate(frames):
            schema = schema or frame.schema
            write_batch(aligned(frame, schema), location, number)
        if schema is None:
            # No batch: a table without columns and rows.
            return self._record("tabular", "empty", location, "[]", lifecycle)
        structure = structure_of(schema)
        return self._record("tabular", "batches", location, structure, lifecycle)

    def persist_documents(self, documents: Documents, lifecycle: Lifecycle) -> Descriptor:
        """Write every document as one line of compact JSON after checking it."""
        location = self._location(lifecycle)
        documents = documents.assembled()
        keys = [k.ascending_column() for k in documents.order]
        rows = documents.df.withColumn("body", compact(F.col("body")))
        rows = rows.orderBy(*keys) if keys else rows
        rows.select(F.col("body").alias("value")).write.mode("errorifexists").text(location)
        return self._record("document", "json", location, "[]", lifecycle)

    def open(self, dataset_id: str) -> Table | Documents:
        """Re-open a dataset; its files must still have the recorded structure."""
        found = self.manifest().where(F.col("id") == dataset_id).limit(1).collect()
        if not found:
            raise DataError("The dataset is not in the manifest.")
        return self.open_descriptor(Descriptor(**found[0].asDict()))

    def open_descriptor(self, descriptor: Descriptor) -> Table | Documents:
        if descriptor.format == "empty":
            return Table(self.spark.createDataFrame([], T.StructType([])))
        if descriptor.family == "document":
            text = self.spark.read.text(descriptor.location)
            keys = [
                F.col("_metadata.file_path"),
                F.col("_metadata.file_block_start"),
                F.monotonically_increasing_id(),
            ]
            hidden = [k.alias(f"{HIDDEN}{i}") for i, k in enumerate(keys)]
            order = tuple(OrderKey(f"{HIDDEN}{i}") for i in range(len(keys)))
            return Documents(text.select(F.col("value").alias("body"), *hidden), order)
        df = self.spark.read.parquet(descriptor.location)
        order = tuple(OrderKey(*key) for key in json.loads(descriptor.row_order))
        if order:
            table = Table(df, order, shuffled=True)
        else:
            table = in_file_order(df, BATCH if descriptor.format == "batches" else None)
        recorded = [(n, t) for n, t, _ in json.loads(descriptor.structure)]
        if [(f.name, f.dataType.simpleString()) for f in table.schema] != recorded:
            raise SchemaError("The files of the dataset differ from its recorded structure.")
        return table

    def table(self, dataset: str | Descriptor) -> Table:
        opened = self._opened(dataset)
        if not isinstance(opened, Table):
            raise SchemaError("The dataset is not tabular.")
        return opened

    def documents(self, dataset: str | Descriptor) -> Documents:
        opened = self._opened(dataset)
        if not isinstance(opened, Documents):
            raise SchemaError("The dataset is not a document.")
        return opened

    def manifest(self) -> DataFrame:
        if not storage.exists(self.spark, self.manifest_path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self.manifest_path).distinct()

    def compact(self) -> int:
        """Bring the manifest, one small file per dataset, together in one."""
        return merge_files(self.spark, self.manifest_path, MANIFEST)

    def _opened(self, dataset: str | Descriptor) -> Table | Documents:
        return self.open(dataset) if isinstance(dataset, str) else self.open_descriptor(dataset)

    def _location(self, lifecycle: Lifecycle) -> str:
        return f"{self.root}/runs/{lifecycle.run_id}/datasets/{uuid.uuid4().hex}"

    def _record(
        self,
        family: str,
        format: str,
        location: str,
        structure: str,
        lifecycle: Lifecycle,
        row_order: str = "[]",
    ) -> Descriptor:
        descriptor = Descriptor(
            id=location.rsplit("/", 1)[1],
            family=family,
            format=format,
            location=location,
            structure=structure,
            row_order=row_order,
            pipeline_id=lifecycle.pipeline_id,
            run_id=lifecycle.run_id,
            step_id=lifecycle.step_id,
            created_at=datetime.now(UTC),
            expires_at=lifecycle.expiry(self.retention),
        )
        append_row(self.spark, self.manifest_path, asdict(descriptor), MANIFEST)
        return descriptor


def aligned(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the first batch, in its types; a value that does not fit fails."""
    if set(frame.columns) != set(schema.names):
        raise SchemaError("A batch has other columns than the first one.")
    return frame.select(*[col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_batch(frame: DataFrame, location: str, number: int) -> None:
    """Write one batch under its number; a repeated batch replaces itself."""
    target = f"{location}/{BATCH}={number}"
    frame.write.mode("overwrite").option("compression", "zstd").parquet(target)
