"""Parquet tables whose content is named by numbered snapshots, replaced in one step.

A table folder holds `data/` with the part files of every load, and `snapshots/` with
small files that name the parts of one state of the table.  The state is the snapshot of
the greatest number that is complete.  A load writes its parts first, under a name of its
own, and then creates the next snapshot exclusively: readers see the state before it or
after it, never one in between, and of two writers one has to look again.  A snapshot
ends in a mark, so one whose writer was lost is passed over.

For each part a snapshot keeps the least and greatest key values, so an append looks for
conflicts only in parts its keys can be in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError, DataError
from ..table import Table, col, require_columns
from . import storage
from ..sources.dataset import stored
from .relational import new_rows

END = "end"
ATTEMPTS = 20


@dataclass(frozen=True)
class Snapshot:
    """One state of a table: its number, its schema and its parts, a JSON line each."""

    number: int
    schema: T.StructType
    parts: tuple[str, ...]


@dataclass(frozen=True)
class SnapshotTarget:
    """Tables below a root, with `keys` as the unique constraint of each.

    Replace and append each become visible in one step.  Appends add the first row of
    every new key whose columns are all filled; if another writer came first, the load is
    compared with the state that writer left.  An append needs the columns the table has.
    """

    root: str
    keys: Mapping[str, Sequence[str]]

    def path(self, relation: str) -> str:
        return f"{self.root.rstrip('/')}/{relation}"

    def read(self, spark: SparkSession, relation: str) -> DataFrame:
        found = latest(spark, self.path(relation))
        if found is None:
            raise DataError("The table has no snapshot.")
        return self._rows(spark, relation, found.schema, found.parts)

    def deliver(self, table: Table, relation: str, mode: str, run_id: str) -> None:
        spark = table.df.sparkSession
        path = self.path(relation)
        keys = list(self.keys.get(relation, ()))
        if mode != "replace" and not keys:
            raise ConfigError("Appending needs the unique key of the target table.")
        require_columns(table.columns, keys)
        if mode == "replace":
            schema, parts = table.schema, self._written(table.ordered_frame(), path, run_id, keys)
            for _ in range(ATTEMPTS):
                if commit(spark, path, Snapshot(next_number(spark, path), schema, parts)):
                    return
            raise DataError("The table is written to by too many others.")
        load = stored(table, "load")
        for _ in range(ATTEMPTS):
            number, known = next_number(spark, path), latest(spark, path)
            if known is not None and sorted(known.schema.fieldNames()) != sorted(table.columns):
                raise DataError("The load does not have the columns of its target table.")
            near = self._candidates(load, keys, known)
            present = self._rows(spark, relation, known.schema, near) if near else None
            schema = known.schema if known is not None else table.schema
            rows = table.observed(new_rows(load, keys, present)).select(*[col(f.name).cast(f.dataType) for f in schema])
            parts = self._written(rows, path, run_id, keys)
            if commit(spark, path, Snapshot(number, schema, (known.parts if known else ()) + parts)):
                return
        raise DataError("The table is written to by too many others.")

    def _rows(self, spark: SparkSession, relation: str, schema: T.StructType, parts: Sequence[str]) -> DataFrame:
        files = [f"{self.path(relation)}/{json.loads(p)['file']}" for p in parts]
        return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)

    @staticmethod
    def _written(rows: DataFrame, path: str, run_id: str, keys: list[str]) -> tuple[str, ...]:
        """Write the parts of a load and describe them; only key columns are read again."""
        spark = rows.sparkSession
        folder = f"data/{run_id}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{folder}")
        if not storage.visible_files(spark, f"{path}/{folder}"):
            return ()
        name = F.regexp_extract("_metadata.file_path", "([^/]*)$", 1)
        kept = spark.read.schema(rows.schema).parquet(f"{path}/{folder}").select(
            F.concat(F.lit(f"{folder}/"), name).alias("__file"), *[col(k) for k in keys]
        )
        bounds = [F.struct(*[f(col(k)).alias(k) for k in keys]).alias(b) for b, f in (("low", F.min), ("high", F.max))]
        parts = kept.groupBy("__file").agg(F.count(F.lit(1)).alias("rows"), *(bounds if keys else []))
        line = F.to_json(F.struct(F.col("__file").alias("file"), "rows", *(("low", "high") if keys else ())))
        return tuple(sorted(r.line for r in parts.select(line.alias("line")).collect()))  # a line a file

    @staticmethod
    def _candidates(load: Table, keys: list[str], known: Snapshot | None) -> list[str]:
        """The parts whose key ranges meet those of the load."""
        if known is None or not known.parts:
            return []
        spark = load.df.sparkSession
        kinds = T.StructType([T.StructField(k, known.schema[k].dataType) for k in keys])
        kind = T.StructType().add("low", kinds).add("high", kinds)
        names = [f"k{i}" for i in range(len(keys))]
        mine = [f(col(k)).alias(f"{n}_{b}") for k, n in zip(keys, names) for b, f in (("low", F.min), ("high", F.max))]
        bounds = load.df.agg(F.struct(*mine).alias("bounds")).scalar()
        parts = spark.createDataFrame([(p,) for p in known.parts], "line string").withColumn("part", F.from_json("line", kind))
        meets = F.lit(True)
        for key, name in zip(keys, names):
            of = F.col("part")
            meets &= (of["low"][key] <= bounds[f"{name}_high"]) & (of["high"][key] >= bounds[f"{name}_low"])
        return [r.line for r in parts.where(meets).select("line").collect()]

    def expire(self, spark: SparkSession, relation: str, keep: int = 2) -> None:
        """Remove all but the last snapshots, and the loads that none of these names.

        No writer may be at work: parts of a load that is not committed yet are removed too.
        """
        path = self.path(relation)
        numbers = snapshot_numbers(spark, path)
        kept = [s for s in (read_snapshot(spark, path, n) for n in numbers[-keep:]) if s is not None]
        named = {json.loads(p)["file"].split("/")[1] for s in kept for p in s.parts}
        for number in numbers[:-keep]:
            storage.remove(spark, snapshot_file(path, number))
        for folder in storage.folders(spark, f"{path}/data"):
            if folder not in named:
                storage.remove(spark, f"{path}/data/{folder}")


def snapshot_file(path: str, number: int) -> str:
    return f"{path}/snapshots/{number:020d}"


def snapshot_numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(f.rsplit("/", 1)[1]) for f in storage.visible_files(spark, f"{path}/snapshots")]


def next_number(spark: SparkSession, path: str) -> int:
    return max(snapshot_numbers(spark, path), default=0) + 1


def read_snapshot(spark: SparkSession, path: str, number: int) -> Snapshot | None:
    """A snapshot, or none if its writer has not ended it."""
    lines = storage.read_text(spark, snapshot_file(path, number)).splitlines()
    if len(lines) < 2 or lines[-1] != END:
        return None
    return Snapshot(number, T.StructType.fromJson(json.loads(lines[0])), tuple(lines[1:-1]))


def latest(spark: SparkSession, path: str) -> Snapshot | None:
    for number in reversed(snapshot_numbers(spark, path)):
        found = read_snapshot(spark, path, number)
        if found is not None:
            return found
    return None


def commit(spark: SparkSession, path: str, snapshot: Snapshot) -> bool:
    """Create the snapshot; false if another writer has taken its number."""
    lines = [json.dumps(snapshot.schema.jsonValue()), *snapshot.parts, END]
    return storage.create_text(spark, snapshot_file(path, snapshot.number), "\n".join(lines))
