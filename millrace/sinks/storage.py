"""The few file system calls a Spark job does not make by itself."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str) -> tuple[Any, Any]:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def exists(spark: SparkSession, path: str) -> bool:
    files, location = _handle(spark, path)
    return files.exists(location)


def size_bytes(spark: SparkSession, path: str) -> int:
    files, location = _handle(spark, path)
    return files.getContentSummary(location).getLength()


def matched_bytes(spark: SparkSession, pattern: str) -> int:
    """The size of all files and folders a path or glob names."""
    files, location = _handle(spark, pattern)
    found = files.globStatus(location) or []
    return sum(files.getContentSummary(f.getPath()).getLength() for f in found)


def has_empty_file(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob names a visible file without any byte, also in a folder."""
    files, location = _handle(spark, pattern)
    for found in files.globStatus(location) or []:
        inside = files.listFiles(found.getPath(), True)
        base = len(found.getPath().toUri().getPath())
        while inside.hasNext():
            entry = inside.next()
            parts = entry.getPath().toUri().getPath()[base:].split("/")
            hidden = any(p.startswith(("_", ".")) for p in parts if p)
            if entry.getLen() == 0 and not hidden:
                return True
    return False


def visible_files(spark: SparkSession, path: str) -> list[str]:
    """The data files directly in a folder; none if there is no folder."""
    files, location = _handle(spark, path)
    if not files.exists(location):
        return []
    found = [f.getPath() for f in files.listStatus(location) if f.isFile()]
    return sorted(p.toString() for p in found if not p.getName().startswith(("_", ".")))


def remove(spark: SparkSession, path: str) -> None:
    files, location = _handle(spark, path)
    files.delete(location, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    files, origin = _handle(spark, source)
    if not files.rename(origin, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError("A table folder could not be moved.")


def swap_in(spark: SparkSession, staged: str, target: str, run_id: str) -> None:
    """Put a staged folder in the place of another; the old one returns on failure."""
    old = f"{target}.old-{run_id}"
    had_old = exists(spark, target)
    if had_old:
        move(spark, target, old)
    try:
        move(spark, staged, target)
    except Exception:
        if had_old:
            move(spark, old, target)
        raise
    if had_old:
        remove(spark, old)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders directly in a folder."""
    files, location = _handle(spark, path)
    if not files.exists(location):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(location) if f.isDirectory())


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    files, location = _handle(spark, path)
    stream = files.open(location)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small text file; false if there is one of that name already."""
    files, location = _handle(spark, path)
    try:
        stream = files.create(location, False)
    except Exception:
        if files.exists(location):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True
