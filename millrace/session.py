"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SETTINGS = {
    # Zone-free timestamps are converted through the session zone.
    "spark.sql.session.timeZone": "UTC",
    # Column names are data here: `Id` and `id` are two columns.
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    # Joins by run or owner may meet a hot key; adaptive execution splits it.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Ranks are cut before their shuffle too, however many rows are kept.
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
    "spark.sql.parquet.compression.codec": "zstd",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime settings the operators assume and return the session.

    The package itself is shipped to the Python workers, once per application.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark, os.path.dirname(os.path.abspath(__file__)))
    return spark


def ship(spark: SparkSession, package: str) -> None:
    """Send a Python package to the workers of this application, once."""
    context = spark.sparkContext
    shipped = context.__dict__.setdefault("_millrace_shipped", set())
    if package in shipped:
        return
    name = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="millrace-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    shipped.add(package)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local master may fall back to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master.startswith("local"):
        if getattr(context, "_millrace_folder", None) is None:
            context._millrace_folder = tempfile.mkdtemp(prefix="millrace-")
        return context._millrace_folder
    raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of a few rows as a local relation: no job, no Python worker, exact size."""
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=fields.names), fields)


def scratch_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/millrace/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one intermediate table."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables; frames that read them are void afterwards."""
    location = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
