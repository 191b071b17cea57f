"""Paged web APIs as a stream: every micro-batch asks all endpoints for what came since.

A batch is a round of requests.  Its offset holds, for each endpoint, the page token and
the value its requests begin from, so a batch that is repeated asks for the same pages;
the driver only plans, pages are read in tasks.  A task puts the pages of an endpoint in
the folder of the round before it passes them on, and a repeated task or batch takes them
from there: what a round delivers is decided once.  A round is planned when the round
before it has all its endpoints' pages.

    location/<round>/plan            the offset of the round
    location/<round>/<name>.parquet  the pages of an endpoint, complete if it is there
    location/<round>/<name>.state    where the endpoint's next round begins
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import DataError
from .pages import PAGE_ARROW, PAGE_SCHEMA, Address, PagedSource, Transport, chain_reader, fetch

STREAM_SCHEMA = f"{PAGE_SCHEMA}, round long"
_ASKED = pa.schema([(name, pa.string()) for name in ("url", "path", "page_token", "value")])
READERS = 16


@dataclass(frozen=True)
class Rounds:
    """What a stream asks, and the folder its rounds are kept in."""

    source: PagedSource
    transport: Transport
    endpoints: tuple[str, ...]
    location: str
    tasks: int

    def folder(self, number: int) -> str:
        return f"{self._root()[1]}/{number:012d}"

    def files(self) -> fs.FileSystem:
        return self._root()[0]

    def _root(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", self.location))
        return files, root.rstrip("/")

    def known(self) -> list[int]:
        """The rounds whose folders are there."""
        files, root = self._root()
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def read_json(self, path: str):
        """The content of a small file, or None if it is not there."""
        files = self.files()
        if files.get_file_info(path).type != fs.FileType.File:
            return None
        with files.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def put(self, path: str, write) -> None:
        """Let `write` fill a file that appears under its name only when it is complete."""
        files, staged = self.files(), f"{path}.{uuid.uuid4().hex}.part"
        with files.open_output_stream(staged) as out:
            write(out)
        if files.get_file_info(path).type == fs.FileType.File:
            files.delete_file(staged)  # another attempt was first, and its pages count
            return
        files.move(staged, path)

    def plan(self, number: int) -> dict | None:
        return self.read_json(f"{self.folder(number)}/plan")

    def results(self, plan: dict) -> dict | None:
        """Where each endpoint of a round ended, or None while one is missing."""
        paths = [f"{self.folder(plan['round'])}/{_name(url)}.state" for url in plan["from"]]
        with ThreadPoolExecutor(READERS) as pool:
            states = list(pool.map(self.read_json, paths))
        return None if None in states else dict(zip(plan["from"], states))


def page_stream(
    spark: SparkSession,
    source: PagedSource,
    endpoints: Sequence[str | tuple[str, str]],
    location: str,
    transport: Transport | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Page rows as `PagedSource.read` gives them, with the `round` they were read in.

    `endpoints` are addresses, or pairs of address and path; offsets name each of them, so
    a stream is meant for thousands, not millions.  An endpoint that is new in a later run
    begins at its start, one that is left out is not asked any more.  `location` belongs
    to one query, as its checkpoint does.  `tasks` bounds how many endpoints are read at once.
    """
    pairs = [(e, None) if isinstance(e, str) else e for e in endpoints]
    addresses = tuple(dict.fromkeys(Address.of(url).below(path).text() for url, path in pairs))
    tasks = tasks or spark.sparkContext.defaultParallelism
    api = _data_source(Rounds(source, transport or fetch, addresses, location, tasks))
    spark.dataSource.register(api)
    return spark.readStream.format(api.name()).load()


def _data_source(rounds: Rounds) -> type[DataSource]:
    # The configuration travels with the class: options would show a token in plans.
    label = f"millrace_pages_{uuid.uuid4().hex}"

    class PagedApi(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return STREAM_SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return RoundReader(rounds)

    return PagedApi


@dataclass
class RoundPart(InputPartition):
    """Endpoints of one round: (address, page token, value) each."""

    round: int
    asked: list[tuple[str, str | None, str | None]]


class RoundReader(DataSourceStreamReader):
    def __init__(self, rounds: Rounds):
        self.rounds = rounds

    def initialOffset(self) -> dict:
        return {"round": 0, "from": {}}

    def latestOffset(self) -> dict:
        rounds = self.rounds
        last = next((plan for n in reversed(rounds.known()) if (plan := rounds.plan(n))), self.initialOffset())
        ends = rounds.results(last)
        if ends is None:
            return last
        begin = {"pageToken": None, "value": None}
        following = {"round": last["round"] + 1, "from": {url: ends.get(url, begin) for url in rounds.endpoints}}
        folder = rounds.folder(following["round"])
        rounds.files().create_dir(folder)
        rounds.put(f"{folder}/plan", lambda out: out.write(json.dumps(following).encode()))
        return following

    def partitions(self, start: dict, end: dict) -> list[RoundPart]:
        parts = []
        for number in range(start["round"] + 1, end["round"] + 1):
            plan = end if number == end["round"] else self.rounds.plan(number)
            if plan is None:
                raise DataError("The pages of an earlier round are gone; a new query needs a new location.")
            asked = [(url, state["pageToken"], state["value"]) for url, state in sorted(plan["from"].items())]
            lists = [asked[i :: self.rounds.tasks] for i in range(self.rounds.tasks)]
            parts += [RoundPart(number, some) for some in lists if some]
        return parts

    def read(self, partition: RoundPart) -> Iterator[pa.RecordBatch]:
        for asked in partition.asked:
            yield from self._pages(partition.round, *asked)

    def _pages(self, number: int, url: str, token: str | None, value: str | None) -> Iterator[pa.RecordBatch]:
        rounds = self.rounds
        stem = f"{rounds.folder(number)}/{_name(url)}"
        if rounds.files().get_file_info(f"{stem}.parquet").type != fs.FileType.File:
            row = pa.RecordBatch.from_pylist([{"url": url, "page_token": token, "value": value}], schema=_ASKED)

            def write(out) -> None:
                # A row group per page, since a page may be as large as the response limit.
                with pq.ParquetWriter(out, PAGE_ARROW) as pages:
                    for page in chain_reader(rounds.source, rounds.transport)(iter([row])):
                        pages.write_batch(page)

            rounds.put(f"{stem}.parquet", write)
        state = {"pageToken": token, "value": value}
        with rounds.files().open_input_file(f"{stem}.parquet") as stored:
            pages = pq.ParquetFile(stored)
            for group in range(pages.num_row_groups):
                for page in pages.read_row_group(group).to_batches():
                    yield page.append_column("round", pa.array([number] * page.num_rows, pa.int64()))
                    last = page.slice(page.num_rows - 1).to_pylist()[0]
                    state = {"pageToken": last["page_token"], "value": last["value"]}
        rounds.put(f"{stem}.state", lambda out: out.write(json.dumps(state).encode()))

    def commit(self, end: dict) -> None:
        """Rounds before a finished one are not asked for again."""
        for number in self.rounds.known():
            if number < end["round"]:
                self.rounds.files().delete_dir(self.rounds.folder(number))


def _name(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()
