"""Table sinks: atomic replace and retry-safe append.

Over JDBC executors load a staging table in parallel and one short transaction on
the driver moves its rows to the target.  Rows are first written to the shared
folder, which fixes each row's file and number: a task that loads its rows twice
then stages the same keys twice, and the transaction takes each key once.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from dataclasses import field as dataclass_field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import check_value, option
from ..errors import ConfigError, DataError, SchemaError
from ..operators.rows import DeduplicateRows
from ..session import scratch_path
from ..sources.dataset import stored
from ..sources.relational import quote_identifier, quote_relation
from ..table import Table, col, require_columns
from . import storage

MODES = ("replace", "append")
LOG = logging.getLogger(__name__)
STAGE_PART, STAGE_ROW = "stage_part", "stage_row"


class Target(Protocol):
    """A place that takes whole tables."""

    def deliver(self, table: Table, relation: str, mode: str, run_id: str) -> None: ...


@dataclass(frozen=True)
class RelationalSink:
    """Deliver a table to `targetTable`, replacing it or appending to it."""

    target_table: str = option("text", key="targetTable")
    write_mode: str = option("select", key="writeMode", choices=MODES, default="replace")
    connection_url: str | None = option("text", key="connectionUrl", default=None, secret=True)

    def __post_init__(self) -> None:
        if not isinstance(self.target_table, str) or not self.target_table:
            raise ConfigError("targetTable is required.")
        quote_relation(self.target_table)
        check_value("select", "writeMode", self.write_mode, MODES)

    def write(self, table: Table, run_id: str, target: Target | None = None) -> None:
        if not table.columns:
            raise SchemaError("A table sink needs at least one column.")
        if target is None:
            if not self.connection_url:
                raise ConfigError("The table sink needs a connection.")
            target = JdbcTarget(self.connection_url)
        target.deliver(table, self.target_table, self.write_mode, run_id)


# -- JDBC --------------------------------------------------------------------------


@dataclass(frozen=True)
class Statements:
    """The SQL of one delivery; identifiers are checked and quoted."""

    create_stage: str
    deliver: tuple[str, ...]
    drop_stage: str


def statements(relation: str, columns: Sequence[str], mode: str, run_id: str) -> Statements:
    target = quote_relation(relation)
    stage = quote_identifier(stage_name(run_id))
    names = ", ".join(quote_identifier(c) for c in columns)
    part, row = quote_identifier(STAGE_PART), quote_identifier(STAGE_ROW)
    once = (
        f"SELECT {names} FROM (SELECT {names}, ROW_NUMBER() OVER (PARTITION BY {part}, {row}"
        f" ORDER BY {part}) AS stage_copy FROM {stage}) AS staged WHERE stage_copy = 1"
    )
    insert = f"INSERT INTO {target} ({names}) {once}"
    if mode == "replace":
        deliver = (f"TRUNCATE TABLE {target}", insert)
    else:
        deliver = (f"{insert} ON CONFLICT DO NOTHING",)
    create = (
        f"CREATE TABLE {stage} AS SELECT {names}, CAST(NULL AS INTEGER) AS {part},"
        f" CAST(NULL AS BIGINT) AS {row} FROM {target} WHERE 1 = 0"
    )
    return Statements(create, deliver, f"DROP TABLE IF EXISTS {stage}")


def stage_name(run_id: str) -> str:
    """A name of its own for every run id, however long and whatever it is spelled with."""
    return "stage_" + hashlib.sha256(run_id.encode()).hexdigest()[:48]


@dataclass(frozen=True)
class JdbcTarget:
    """A database reached over JDBC; `connect` may replace the driver manager."""

    url: str = dataclass_field(repr=False)
    properties: Mapping[str, str] = dataclass_field(default_factory=dict, repr=False)
    batch_size: int = 10_000
    connect: Callable[[SparkSession], Any] | None = None
    load: Callable[[DataFrame, str], None] | None = None

    def deliver(self, table: Table, relation: str, mode: str, run_id: str) -> None:
        spark = table.df.sparkSession
        sql = statements(relation, table.columns, mode, run_id)
        staged = self._fixed_rows(table)
        connection = self._connection(spark)
        try:
            connection.setAutoCommit(True)
            _execute(connection, [sql.drop_stage, sql.create_stage])
            (self.load or self._load)(staged, quote_identifier(stage_name(run_id)))
            connection.setAutoCommit(False)
            _execute(connection, sql.deliver)
            connection.commit()
        except Exception:
            _quietly(connection.rollback)
            raise DataError("The table was not delivered; its transaction was rolled back.") from None
        finally:
            # What happens from here on leaves the outcome as it is.
            _quietly(lambda: connection.setAutoCommit(True))
            _quietly(lambda: _execute(connection, [sql.drop_stage]))
            _quietly(connection.close)

    @staticmethod
    def _fixed_rows(table: Table) -> DataFrame:
        spark = table.df.sparkSession
        path = scratch_path(spark, "stage")
        table.frame().write.parquet(path)
        rows = spark.read.parquet(path)
        part = F.regexp_extract(F.col("_metadata.file_path"), r"/part-([0-9]+)", 1).cast("int")
        # A file name ends in a counter where one task wrote several files.
        number = F.regexp_extract(F.col("_metadata.file_path"), r"-c([0-9]+)\.", 1).cast("bigint")
        row = number * F.lit(2**40) + F.col("_metadata.row_index")
        return rows.select("*", part.alias(STAGE_PART), row.alias(STAGE_ROW))

    def _load(self, rows: DataFrame, stage: str) -> None:
        rows.write.format("jdbc").mode("append").options(
            url=self.url, dbtable=stage, batchsize=self.batch_size, **self.properties
        ).save()

    def _connection(self, spark: SparkSession) -> Any:
        if self.connect is not None:
            return self.connect(spark)
        try:
            settings = spark._jvm.java.util.Properties()
            for key, value in self.properties.items():
                settings.setProperty(key, value)
            if "driver" in self.properties:
                spark._jvm.java.lang.Class.forName(self.properties["driver"])
            return spark._jvm.java.sql.DriverManager.getConnection(self.url, settings)
        except Exception:
            raise DataError("The database could not be reached.") from None


def _quietly(clean_up: Callable[[], Any]) -> None:
    try:
        clean_up()
    except Exception:
        LOG.warning("A clean-up after a delivery failed.")


def _execute(connection: Any, texts: Sequence[str]) -> None:
    statement = connection.createStatement()
    try:
        for text in texts:
            statement.execute(text)
    finally:
        statement.close()


# -- folders -----------------------------------------------------------------------


@dataclass(frozen=True)
class FolderTarget:
    """Parquet tables below a root, with `keys` as the unique constraint of each.

    Append adds the first row of every new key whose columns are all filled; a key
    with a null never conflicts, as in SQL.  The load is written to the shared folder
    first, as it is looked at more than once.  One writer per table at a time.
    """

    root: str
    keys: Mapping[str, Sequence[str]]

    def path(self, relation: str) -> str:
        return f"{self.root.rstrip('/')}/{relation}"

    def deliver(self, table: Table, relation: str, mode: str, run_id: str) -> None:
        spark = table.df.sparkSession
        path = self.path(relation)
        if mode == "replace":
            staged = f"{path}.stage-{run_id}"
            table.ordered_frame().write.mode("overwrite").parquet(staged)
            storage.swap_in(spark, staged, path, run_id)
            return
        if relation not in self.keys:
            raise ConfigError("Appending needs the unique key of the target table.")
        keys = list(self.keys[relation])
        require_columns(table.columns, keys)
        present = spark.read.parquet(path) if storage.exists(spark, path) else None
        load = stored(table, "load")
        table.observed(new_rows(load, keys, present)).write.mode("append").parquet(path)


def new_rows(table: Table, keys: Sequence[str], present: DataFrame | None) -> DataFrame:
    """The rows that do not hit the unique key of what is present."""
    filled = F.lit(True)
    for key in keys:
        filled = filled & col(key).isNotNull()
    keyed = Table(table.df.where(filled), table.order)
    first = DeduplicateRows(list(keys))(keyed).frame()
    if present is not None:
        first = first.join(conflicts(first, keys, present), list(keys), "left_anti")
    unkeyed = table.df.where(~filled).select(*[col(c) for c in table.columns])
    return first.select(*[col(c) for c in table.columns]).unionByName(unkeyed)


def conflicts(first: DataFrame, keys: Sequence[str], present: DataFrame) -> DataFrame:
    """The keys of both sides.

    The target is the left side of a semi join, so a small load is broadcast by
    Catalyst and the target is scanned without a shuffle; both sides have one row
    per key, so no key is hot.
    """
    names = [col(k) for k in keys]
    return present.select(*names).join(first.select(*names), list(keys), "left_semi")
