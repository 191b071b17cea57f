"""Records of delimited files whose quoted fields hold line breaks, read split by split.

A quote opens or closes a field, so whether a line begins inside one is the parity of the
quotes before it.  One pass counts the quotes of every split; totalled over the splits of
a file they tell each split whether it begins inside a record.  A second pass joins the
lines of records within each split.  What crosses a split's end, at most the lines before
its first record and its last record, is put together afterwards.  The records are written
once, since types and rows both read them.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

COMPLETE, HEAD, TAIL = range(3)
FIELDS = "record binary, file string, start long, place long, part int, first boolean, stray boolean"


def lines_of(spark: SparkSession) -> DataFrameReader:
    """Lines end in a line feed alone, so that what precedes one inside a field is kept."""
    return spark.read.option("lineSep", "\n")


def odd_quotes(text: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2


def split_parities(lines: DataFrame) -> list:
    """One row a split: `uri` and `file`, `start`, the parity of its quotes, and whether a line has an odd number."""
    counted = lines.select(
        F.input_file_name().alias("uri"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), odd_quotes("value").alias("odd"),
    )
    return counted.groupBy("uri", "file", "start").agg(
        (F.sum("odd") % 2).alias("parity"), F.max("odd").alias("broken")
    ).collect()


def opened(splits: list) -> dict[tuple[str, int], int]:
    """For each split whether it begins inside a quoted field: the parity of all before it."""
    before: dict[str, int] = {}
    found = {}
    for split in sorted(splits, key=lambda s: (s.file, s.start)):
        found[split.file, split.start] = before.get(split.file, 0)
        before[split.file] = (before.get(split.file, 0) + split.parity) % 2
    return found


class Joiner:
    """Joins the lines of one split to records, batch by batch."""

    def __init__(self, file: str, start: int, inside: int, separator: str):
        self.file, self.start, self.separator = file, start, separator
        self.parity = inside
        self.held: list[bytes] = []
        self.held_place = 0
        self.tail = bool(inside)  # whether the held lines belong to a record of a split before
        self.seen = False
        self.out: list[tuple] = []

    def add(self, values: pa.Array, places: np.ndarray) -> None:
        quotes = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) & 1
        after = (self.parity + np.cumsum(quotes)) & 1
        begins = np.flatnonzero(np.concatenate([[self.parity], after[:-1]]) == 0)
        self.parity = int(after[-1])
        stop = int(begins[0]) if len(begins) else len(values)
        self.held += values.slice(0, stop).to_pylist()
        if not len(begins):
            return
        self.flush()
        ends = np.append(begins[1:], len(values))
        whole = len(begins) - (self.parity == 1)  # the last goes on in the next batch
        if whole:
            offsets = pa.array(np.append(begins[:whole], ends[whole - 1]).astype(np.int32))
            records = pc.binary_join(pa.ListArray.from_arrays(offsets, values), b"\n")
            several = (ends - begins > 1)[:whole].tolist()
            for record, place, more in zip(records.to_pylist(), places[begins[:whole]].tolist(), several):
                self.put(record, place, COMPLETE, more)
        if whole < len(begins):
            self.held = values.slice(int(begins[-1])).to_pylist()
            self.held_place = int(places[begins[-1]])

    def put(self, record: bytes, place: int, part: int, several: bool) -> None:
        if part == COMPLETE:
            record = record.removesuffix(b"\r")
            if not record:
                return
        first = self.start == 0 and not self.seen and part != TAIL
        self.seen = True
        stray = several and part == COMPLETE and is_stray(record, self.separator)
        self.out.append((record, self.file, self.start, place, part, first, stray))

    def flush(self) -> None:
        """A record has begun, so what is held is whole, or the rest of an earlier split's record."""
        if self.held:
            self.put(b"\n".join(self.held), self.held_place, TAIL if self.tail else COMPLETE, True)
        self.held, self.tail = [], False

    def close(self) -> None:
        if self.held:
            open_end = TAIL if self.tail else HEAD if self.parity else COMPLETE
            self.put(b"\n".join(self.held), self.held_place, open_end, True)
        self.held = []


def is_stray(record: bytes, separator: str) -> bool:
    """Whether a parser would end the record earlier: a quote stands inside an unquoted field."""
    text = io.StringIO(record.decode("utf-8", "replace"), newline="")
    return len(list(csv.reader(text, delimiter=separator))) != 1


def joined(inside, separator: str):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["record", "file", "start", "place", "part", "first", "stray"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = batch.column("start").to_numpy()
            files = batch.column("file").dictionary_encode()
            codes = files.indices.to_numpy()
            edges = np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(starts)]):
                file, start = files.dictionary[int(codes[low])].as_py(), int(starts[low])
                if joiner is None or (joiner.file, joiner.start) != (file, start):
                    if joiner is not None:
                        joiner.close()
                        if joiner.out:
                            yield batch_of(joiner.out)
                    if (file, start) not in inside.value:
                        raise ValueError("The splits of a delimited file changed between two passes.")
                    joiner = Joiner(file, start, inside.value[file, start], separator)
                joiner.add(batch.column("value").slice(low, high - low), batch.column("place").to_numpy()[low:high])
            if joiner.out:
                yield batch_of(joiner.out)
                joiner.out = []
        if joiner is not None:
            joiner.close()
            if joiner.out:
                yield batch_of(joiner.out)

    return run


def records(spark: SparkSession, paths: list[str], inside: dict[tuple[str, int], int], separator: str) -> DataFrame:
    """All records of the files: `record`, `first` of its file or not, `stray`, and `file`, `start`, `place`.

    The driver holds one number a split.
    """
    lines = lines_of(spark).text(paths).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"),
    )
    shared = spark.sparkContext.broadcast(inside)
    path = scratch_path(spark, "records")
    lines.mapInArrow(joined(shared, separator), FIELDS).write.parquet(path)
    parts = spark.read.schema(FIELDS).parquet(path)
    # The rest of a record goes to the last one left open before it in its file.
    origin = Window.partitionBy("file").orderBy("start", F.desc("part"))
    opening = F.last(F.when(F.col("part") == HEAD, F.struct("start", "place")), ignorenulls=True).over(origin)
    pieces = parts.where(F.col("part") != COMPLETE).withColumn("of", opening)
    pieces = pieces.groupBy("file", "of").agg(
        F.sort_array(F.collect_list(F.struct("start", "part", "record"))).alias("pieces"), F.max("first").alias("first")
    )
    texts = F.transform("pieces", lambda p: p["record"].cast("string"))
    whole = F.regexp_replace(F.array_join(texts, "\n"), r"\r\z", "")
    crossing = pieces.select(
        whole.alias("record"), "file", F.col("of.start").alias("start"), F.col("of.place").alias("place"), "first",
        F.lit(False).alias("stray"),
    )
    complete = parts.where(F.col("part") == COMPLETE).withColumn("record", F.col("record").cast("string"))
    return complete.drop("part").unionByName(crossing)


def left_open(splits: list) -> set[str]:
    """Files with an odd number of quotes in all: their last record never ends."""
    total: dict[str, int] = {}
    for split in splits:
        total[split.uri] = (total.get(split.uri, 0) + split.parity) % 2
    return {uri for uri, parity in total.items() if parity}
