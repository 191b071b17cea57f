"""Flatten JSON documents into a table.

Two steps.  `discover` reads the documents once, in parallel, and reduces them to
one small description: which columns, of which type, in which first-seen order.
The flatten itself is then a lazy plan: one typed `from_json` and one generator per
exploded array, all on the JVM.  Documents whose records mix kinds at one path are
flattened by an Arrow-batched helper instead, with equal results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from itertools import pairwise
from typing import Any

import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import check_value, option
from ..errors import ConfigError, DataError, SchemaError
from ..functions.shapes import (
    ROW_LIMIT,
    Path,
    RecordSurvey,
    parse_document,
    record_rows,
    records_of,
    signature,
)
from ..table import HIDDEN, Documents, OrderKey, Table, col

MODES = ("json", "explode")

# A reader of documents has no limits of its own, and no key of a document means more to
# it than another; what it cannot read it names in a hidden field.
CORRUPT = "__corrupt_document"
PARSER = {
    "maxStringLen": str(2**31 - 1),
    "maxNumLen": str(2**31 - 1),
    "maxNestingDepth": str(2**31 - 1),
    "columnNameOfCorruptRecord": CORRUPT,
}
BATCH_ROWS = 4096

# Outlines of records held before they are surveyed.
MAX_OUTLINES = 10_000

SCALARS = {
    "boolean": T.BooleanType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "text": T.StringType(),
    "array": T.StringType(),
}


@dataclass
class Node:
    """One path of the surveyed documents."""

    kinds: set[str] = field(default_factory=set)
    children: dict[str | None, "Node"] = field(default_factory=dict)

    def child(self, key: str | None) -> "Node":
        return self.children.setdefault(key, Node())


@dataclass(frozen=True)
class Shape:
    """The flat schema of a set of documents; may be reused for later documents."""

    columns: tuple[tuple[str, T.DataType], ...]
    paths: dict[str, Path]
    root: Node
    target: str
    typed: bool


@dataclass(frozen=True)
class FlattenDocument:
    """Turn the objects at `record_path` into rows.

    Nested objects become columns joined by `separator`.  Arrays stay compact JSON
    text (`json`) or are expanded as a Cartesian product (`explode`), where an empty
    array removes its record.
    """

    record_path: list[str] = option("json", default=[])
    array_mode: str = option("select", choices=MODES, default="json")
    separator: str = option("text", default=".")

    def __post_init__(self) -> None:
        path = self.record_path
        if not isinstance(path, list | tuple) or not all(
            isinstance(s, str) and s.strip() for s in path
        ):
            raise ConfigError("record_path must list non-blank keys.")
        check_value("select", "array_mode", self.array_mode, MODES)
        if not isinstance(self.separator, str) or not 1 <= len(self.separator) <= 8:
            raise ConfigError("separator must have 1 to 8 characters.")

    @property
    def explode(self) -> bool:
        return self.array_mode == "explode"

    def __call__(self, documents: Documents, shape: Shape | None = None) -> Table:
        """Flatten; without a known `shape` this reads the documents once to find it.

        That pass also checks every document.  With a known shape nothing is read here
        and keys outside it are ignored.  Text that does not fit the shape fails the job.  Documents
        that are costly to make should be written first, as they are read twice.
        """
        if not isinstance(documents, Documents):
            raise SchemaError("Flatten needs documents as its input.")
        documents, path = self._records_side(documents)
        shape = shape or self._discover(documents, path)
        build = self._typed_rows if shape.typed else self._python_rows
        return build(documents, path, shape)

    def discover(self, documents: Documents) -> Shape:
        """Read every document and describe the table it flattens to (one action)."""
        return self._discover(*self._records_side(documents))

    def _records_side(self, documents: Documents) -> tuple[Documents, tuple[str, ...]]:
        """Use the rows of wrapped documents as records without assembling them."""
        path = tuple(self.record_path)
        if not documents.wrapper:
            return documents, path
        if path == documents.wrapper:
            return Documents(documents.df, documents.order), ()
        if not path and self.explode and len(documents.wrapper) == 1:
            # The wrapper has one key, so its rows are those of its elements one by one.
            opening = json.dumps({documents.wrapper[0]: []})[:-2]
            body = F.concat(F.lit(opening), F.col("body"), F.lit("]}")).alias("body")
            keys = [F.col(k.column) for k in documents.order]
            return Documents(documents.df.select(body, *keys), documents.order), ()
        return documents.assembled(), path

    # -- discovery ---------------------------------------------------------

    def _discover(self, documents: Documents, path: tuple[str, ...]) -> Shape:
        order = [k.column for k in documents.order]
        df = documents.df.select("body", *order)
        fields = "section string, column string, path string, kind string"
        schema = T.StructType(
            [
                *T.StructType.fromDDL(fields).fields,
                *[T.StructField(c, df.schema[c].dataType) for c in order],
                *T.StructType.fromDDL("record long, row long, rank long").fields,
            ]
        )
        found = df.mapInArrow(_surveyor(self, path, schema), schema)
        position = F.min(F.struct(*order, "record", "row", "rank")).alias("position")
        facts = found.groupBy("section", "column", "path", "kind").agg(position)
        rows = _collected(facts)
        rows.sort(key=lambda r: _sortable(r["position"]))
        return _shape(rows, self.explode)

    # -- typed projection ---------------------------------------------------

    def _typed_rows(self, documents: Documents, path: tuple[str, ...], shape: Shape) -> Table:
        record_type = _parse_type(shape.root, self.explode) or T.StructType([])
        wanted: T.DataType = record_type
        if shape.target == "array":
            wanted = T.ArrayType(record_type if record_type.fields else T.StringType())
        for segment in reversed(path):
            wanted = T.StructType([T.StructField(segment, wanted)])
        order = list(documents.order)
        hidden = [k.column for k in order]
        readable = F.lit(True)
        if isinstance(wanted, T.StructType):
            wanted = T.StructType([*wanted.fields, T.StructField(CORRUPT, T.StringType())])
            readable = F.col("__json").getField(CORRUPT).isNull()
        df = documents.df.select(*hidden, "body", F.from_json("body", wanted, PARSER).alias("__json"))
        # A document the parser gives up must not become a row of nulls, or no row.
        failure = F.raise_error(F.lit("A document could not be read.")).cast(wanted)
        read = F.col("body").isNull() | (F.col("__json").isNotNull() & readable)
        df = df.select(*hidden, F.when(read, F.col("__json")).otherwise(failure).alias("__json"))
        target = F.col("__json")
        for segment in path:
            target = target.getField(segment)
        state = _Expansion(df, hidden, len(hidden))
        record = state.explode(target, keep_missing=False) if shape.target == "array" else target
        leaves: dict[Path, Column] = {}
        if record_type.fields:
            state.expand(shape.root, record, (), leaves, self.explode)
        outputs = []
        for name, data_type in shape.columns:
            leaf = leaves.get(shape.paths[name])
            outputs.append((F.lit(None).cast(data_type) if leaf is None else leaf).alias(name))
        table = state.df.select(*outputs, *state.hidden)
        keys = order + [OrderKey(c) for c in state.hidden[len(hidden):]]
        return Table(table, tuple(keys), shuffled=False)

    # -- irregular documents -------------------------------------------------

    def _python_rows(self, documents: Documents, path: tuple[str, ...], shape: Shape) -> Table:
        order = [k.column for k in documents.order]
        df = documents.df.select("body", *order)
        extra = [f"{HIDDEN}{len(order) + i}" for i in range(2)]
        schema = T.StructType(
            [
                *[T.StructField(name, data_type) for name, data_type in shape.columns],
                *[T.StructField(c, df.schema[c].dataType) for c in order],
                *[T.StructField(c, T.LongType()) for c in extra],
            ]
        )
        rows = df.mapInArrow(_flattener(self, path, shape.columns, schema), schema)
        keys = [*documents.order, *[OrderKey(c) for c in extra]]
        return Table(rows, tuple(keys), shuffled=False)


class _Expansion:
    """A DataFrame under construction with one generator per array path."""

    def __init__(self, df: DataFrame, hidden: list[str], next_key: int) -> None:
        self.df = df
        self.hidden = list(hidden)
        self.next_key = next_key

    def explode(self, value: Column, keep_missing: bool, element: T.DataType | None = None) -> Column:
        """One row per element; a missing array keeps its row, an empty one drops it."""
        if keep_missing:
            value = F.coalesce(value, F.array(F.lit(None).cast(element)))
        position, item = f"{HIDDEN}{self.next_key}", f"__item{self.next_key}"
        self.next_key += 1
        self.df = self.df.select("*", F.posexplode(value).alias(position, item))
        self.hidden.append(position)
        return F.col(item)

    def expand(
        self, node: Node, value: Column, path: Path, leaves: dict[Path, Column], explode: bool
    ) -> None:
        for key, child in node.children.items():
            data_type = _parse_type(child, explode)
            if data_type is None:
                continue
            here = (*path, key)
            item = value.getField(key)
            if "array" in child.kinds and explode:
                element = data_type.elementType
                item = self.explode(item, True, element)
                child, here = child.child(None), (*here, None)
            if "object" in child.kinds:
                self.expand(child, item, here, leaves, explode)
            else:
                leaves[here] = item


def _parse_type(node: Node, explode: bool) -> T.DataType | None:
    """The `from_json` type of a path, or None where nothing has to be read."""
    if "array" in node.kinds:
        if not explode:
            return T.StringType()
        element = _parse_type(node.children[None], explode) if None in node.children else None
        return T.ArrayType(element or T.StringType())
    if "object" in node.kinds or not node.kinds and node.children:
        fields = [
            T.StructField(key, data_type)
            for key, child in node.children.items()
            if (data_type := _parse_type(child, explode)) is not None
        ]
        return T.StructType(fields) if fields else None
    return _merged(node.kinds) if node.kinds - {"null"} else None


def _merged(kinds: set[str]) -> T.DataType:
    kinds = kinds - {"null"}
    if not kinds:
        return T.StringType()
    if kinds == {"integer", "float"}:
        return T.DoubleType()
    types = {SCALARS[k] for k in kinds}
    if len(types) > 1:
        raise DataError("Document values of one column have different types.")
    return types.pop()


def _shape(rows: list, explode: bool) -> Shape:
    """Assemble the description from the facts, which arrive in first-seen order."""
    root = Node({"object"})
    column_kinds: dict[str, set[str]] = {}
    column_paths: dict[str, list[Path]] = {}
    targets: set[str] = set()
    ghosts: list[tuple[Path, str]] = []
    orders: dict[Path, list[list[str]]] = {}
    value_kinds: dict[Path, set[str]] = {}
    irregular = False
    # Containers first: the children of a node follow the order of its keys.
    for row in sorted(rows, key=lambda r: r["section"] != "container"):
        section, kind = row["section"], row["kind"]
        if section == "target":
            targets.add(kind)
        elif section == "irregular":
            irregular = True
        elif section == "order":
            path, keys = json.loads(row["path"])
            orders.setdefault(tuple(path), []).append(keys)
        else:
            path: Path = tuple(json.loads(row["path"]))
            if section == "ghost":
                ghosts.append((path, kind))
                continue
            node = root
            for key in path:
                node = node.child(key)
            node.kinds.add(kind)
            if section == "column":
                column_kinds.setdefault(row["column"], set()).add(kind)
                value_kinds.setdefault(path, set()).add(kind)
                paths = column_paths.setdefault(row["column"], [])
                if path not in paths:
                    paths.append(path)
    if any(name.startswith(HIDDEN) for name in column_kinds):
        raise SchemaError(f"Document keys must not start with {HIDDEN}.")
    columns = tuple((name, _merged(kinds)) for name, kinds in column_kinds.items())

    def find(path: Path) -> Node | None:
        node: Node | None = root
        for key in path:
            node = node.children.get(key) if node else None
        return node

    typed = not irregular and len(targets) <= 1 and not _mixed(root)
    paths: dict[str, Path] = {}
    for name, candidates in column_paths.items():
        valued = [p for p in candidates if value_kinds[p] - {"null"}] or candidates[:1]
        typed = typed and len(valued) == 1
        paths[name] = valued[0]
    for path, kind in ghosts:
        live = value_kinds.get(path, set()) - {"null"}
        typed = typed and (kind == "null" or not live or kind in live)
    for path, sequences in orders.items():
        typed = typed and _arrange(find(path), sequences)
    return Shape(columns, paths, root, "array" if targets == {"array"} else "object", typed)


def _mixed(node: Node) -> bool:
    kinds = {k if k in ("object", "array") else "scalar" for k in node.kinds - {"null"}}
    return len(kinds) > 1 or any(_mixed(child) for child in node.children.values())


def _arrange(node: Node, sequences: list[list[str]]) -> bool:
    """Order the children of a node as all its objects do; False if they disagree."""
    before: dict[str, set[str]] = {key: set() for keys in sequences for key in keys}
    for keys in sequences:
        for earlier, later in pairwise(keys):
            before[later].add(earlier)
    try:
        arranged = list(TopologicalSorter(before).static_order())
    except CycleError:
        return False
    rest = [key for key in node.children if key not in before]
    node.children = {key: node.children[key] for key in [*arranged, *rest]}
    return True


def _sortable(value):
    if isinstance(value, tuple):
        return tuple(_sortable(v) for v in value)
    return (value is not None, value)


def _collected(df: DataFrame) -> list:
    """Collect a bounded result; errors of the helpers keep their value-free text."""
    try:
        return df.collect()
    except PythonException as error:
        message = re.search(r"DataError: ([^\n]*)", str(error))
        raise DataError(message.group(1) if message else "Documents could not be read.") from None


def _surveyor(config: FlattenDocument, path: tuple[str, ...], schema: T.StructType):
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    explode, separator = config.explode, config.separator
    order = schema.names[4:-3]

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        survey = RecordSurvey(explode, separator)
        first: dict[tuple[str | None, Path, str], tuple] = {}
        targets: set[str] = set()

        # The earliest record of each outline; only these are surveyed.
        outlines: dict[Any, tuple[tuple, dict]] = {}

        def note(key: tuple[str | None, Path, str], position: tuple) -> None:
            if key not in first or position < first[key]:
                first[key] = position

        def survey_outlines() -> None:
            for (place, number), record in outlines.values():
                for row, rank, *entry in survey.survey(record):
                    note(tuple(entry), (place, number, min(row, ROW_LIMIT), rank))
                for rank, (where, kind) in enumerate(survey.containers):
                    note((None, where, kind), (place, number, 0, rank))
            outlines.clear()

        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in order]
            for i, body in enumerate(batch.column("body").to_pylist()):
                if body is None:
                    raise DataError("A document is not valid JSON.")
                place = tuple([(k[i] is not None, k[i]) for k in keys])
                target, records = records_of(parse_document(body), path)
                targets.add(target)
                for number, record in enumerate(records):
                    outline = signature(record, explode)
                    known = outlines.get(outline)
                    if known is None or (place, number) < known[0]:
                        outlines[outline] = ((place, number), record)
                if len(outlines) > MAX_OUTLINES:
                    survey_outlines()
        survey_outlines()
        none = [None] * len(order) + [0, 0, 0]
        facts = [("target", None, None, t, *none) for t in targets]
        facts += [("ghost", None, json.dumps(p), k, *none) for p, k in survey.ghosts]
        facts += [("order", None, json.dumps(o), None, *none) for o in survey.orders]
        if survey.irregular:
            facts.append(("irregular", None, None, None, *none))
        for (column, p, kind), (place, *rest) in first.items():
            section = "container" if column is None else "column"
            facts.append((section, column, json.dumps(p), kind, *[v for _, v in place], *rest))
        for start in range(0, len(facts), BATCH_ROWS):
            part = list(zip(*facts[start : start + BATCH_ROWS]))
            arrays = [pa.array(v, type=f.type) for v, f in zip(part, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return survey


def _flattener(config: FlattenDocument, path: tuple[str, ...], columns, schema: T.StructType):
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    explode, separator = config.explode, config.separator
    names = [name for name, _ in columns]
    floats = {name for name, data_type in columns if isinstance(data_type, T.DoubleType)}
    order = schema.names[len(names) : -2]

    def value_of(row: dict, name: str):
        value = row.get(name)
        return float(value) if name in floats and value is not None else value

    def rows_of(batch: pa.RecordBatch):
        for i, body in enumerate(batch.column("body").to_pylist()):
            _, records = records_of(parse_document(body), path)
            for number, record in enumerate(records):
                for place, row in enumerate(record_rows(record, explode, separator)):
                    yield i, number, place, row

    def packed(batch: pa.RecordBatch, part: list) -> pa.RecordBatch:
        values = [[value_of(row, name) for *_, row in part] for name in names]
        arrays = [pa.array(v, type=arrow.field(n).type) for v, n in zip(values, names)]
        source = pa.array([i for i, *_ in part], type=pa.int64())
        arrays += [batch.column(c).take(source).cast(arrow.field(c).type) for c in order]
        arrays += [pa.array([p[k] for p in part], type=pa.int64()) for k in (1, 2)]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part: list = []
            for item in rows_of(batch):
                part.append(item)
                if len(part) == BATCH_ROWS:
                    yield packed(batch, part)
                    part = []
            if part:
                yield packed(batch, part)

    return flatten
