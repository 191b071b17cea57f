"""Removal of byte strings that start at more than one place, by distributed prefix doubling.

Positions get ranks, a rank names the string that starts there, and pairs of ranks at
growing offsets name strings twice as long.  In each round Spark deals the pairs of all
texts to ranges of their value, each range is sorted, and every position learns whether its
pair occurs again; it goes on until its string is unique, or is past the threshold of
`width` bytes and marks what it covers.

Ranked are not all positions but those that every copy of a string has too: the least
`GRAM`-byte hash in each window of `reach` bytes.  From one such anchor to the next is a
phrase, the first ranks are those of two phrases, and offsets grow in phrases.  A string of
`width` bytes holds an anchor and two phrases after it whatever surrounds it, so an anchor
whose two phrases are unique is in no repeated string with it as first anchor, and is
dropped.  Repeated strings past the threshold are covered for certain.  What is left are
the edges of copied passages: there, strings of exactly `width` bytes that are not yet
covered are ranked once more, with those they can equal (of the same two phrases), and the
repeated ones mark what they cover.

Texts are cut into slices of about `SLICE` bytes, kept in a table bucketed by slice, so the
rounds join answers to texts without moving a text.  A slice sends each rank once, with a
mark if it has it more than once, so a passage in a third of all texts is one value a slice;
an answer is one bit a value.  Ranks are 64-bit hashes; the first rounds send 40 bits and
the range, which can only let more positions go on to the exact round.

Matches never cross texts.  Null and empty texts have no bytes; a text shorter than `width`
loses nothing.  A row repeated in full counts as two occurrences, so both lose all their
bytes if they have `width` of them.  A very long text is one slice.  Columns other than id
and text do not take part.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .frames import partitions, ready, renamed, text_of, written
from .text import blobs, mix, prefix_sums, raw_bytes, rolling, sliding_min, slices, span_hashes

WIDTH = 200
GRAM = 8
SLICE = 3 << 20
SHORT = 5  # bytes a rank is sent with before the exact round
LONG = 8
TIMES = np.uint64(0x9E3779B97F4A7C15)
SPAN = T.StructType().add("start", "long").add("stop", "long")
STATE = ["pos", "order", "core", "span", "back", "count"]
KINDS = [np.int32, np.int64, np.uint64, np.int32, np.int32, np.int32]


def slicing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a slice: its number, the ids and the texts."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0

    def row():
        nonlocal number, size
        table = pa.Table.from_batches(held).combine_chunks()
        lists = [
            pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(c).chunk(0))
            for c in ("id", "text")
        ]
        number, size = number + 1, 0
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), *lists], ["slice", "ids", "texts"])

    for whole in batches:
        for batch in slices([whole], "text", SLICE):
            if not batch.num_rows:
                continue
            binary = batch.column("text").cast(pa.binary())
            held.append(pa.RecordBatch.from_arrays([batch.column("id"), binary], ["id", "text"]))
            size += binary.nbytes
            if size >= SLICE:
                yield row()
    if held:
        yield row()


class Anchors:
    """Anchors of several texts: places, and the first place whose window they are least in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        gram = min(GRAM, max(1, width // 3))
        reach = max(1, (width + 1 - gram) // 3)
        none = np.zeros(0, np.int64)
        self.pos = self.back = self.windows = self.order = none
        self.names = np.zeros(0, np.uint64)
        if len(data) < width:
            return
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        values = np.ndarray((len(data),), "<u8", padded, 0, (1,)) & np.uint64((1 << 8 * gram) - 1)
        values = values * TIMES
        values ^= values >> np.uint64(29)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        # The place in the low half: least value, and of equal ones the first.
        least = sliding_min((values & ~np.uint64(0xFFFFFFFF)) | np.arange(len(data), dtype=np.uint64), reach)
        least = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lengths = np.diff(offsets)
        text = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
        ends = offsets[1:][text]
        fits = (np.arange(len(least)) + reach + gram - 1 <= ends) & (lengths[text] >= width)
        start = np.flatnonzero(fits)
        least, text = least[start], text[start]
        fresh = np.ones(len(start), dtype=bool)
        fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        pos, text, start = least[fresh], text[fresh], start[fresh]
        count = len(pos)
        if count < 3:
            return
        sums = prefix_sums(data.astype(np.uint64) + np.uint64(1))
        phrase = np.zeros(count, np.uint64)
        on = np.flatnonzero(text[1:] == text[:-1])
        phrase[on] = span_hashes(sums, pos[on], pos[on + 1] + gram)
        two = np.flatnonzero(text[2:] == text[:-2])
        self.pos, self.names = pos[two], mix(phrase[two] * TIMES + phrase[two + 1])
        self.span = pos[two + 2] + gram - pos[two]
        self.back = pos[two] - start[two]
        # Places whose first anchor this is and that have `width` bytes of their text ahead.
        last = np.minimum(start[two + 1] - 1, offsets[1:][text[two]] - width)
        self.windows = np.maximum(last - start[two] + 1, 0)
        # Orders of texts lie so far apart that no offset leads from one to the next.
        self.order = two + text[two] * (2 * width)


class Question:
    """Distinct values of one slice, dealt to ranges, and the answers to them."""

    def __init__(self, values: np.ndarray, ranges: int, deal: np.ndarray | None = None, marks: np.ndarray | None = None):
        self.values, first, self.inverse, counts = np.unique(
            values, return_index=True, return_inverse=True, return_counts=True
        )
        self.marks = counts > 1 if marks is None else np.bincount(self.inverse, marks, len(counts)) > 0
        high = (self.values if deal is None else deal[first]) >> np.uint64(32)
        at = (high * np.uint64(ranges)) >> np.uint64(32)
        self.order = np.argsort(at, kind="stable")
        self.bounds = np.searchsorted(at[self.order], np.arange(ranges + 1))

    def rows(self, number: int, size: int) -> pa.RecordBatch:
        sent = self.values[self.order].view(np.uint8).reshape(-1, 8)[:, :size].ravel()
        full = np.flatnonzero(np.diff(self.bounds))
        edges = np.append(self.bounds[full], len(self.values))
        marks = self.marks[self.order]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full.astype(np.int32)),
                pa.array(np.full(len(full), number, np.int64)),
                blobs(sent, edges * size),
                pa.array([np.packbits(marks[b:e]).tobytes() for b, e in zip(edges[:-1], edges[1:])], pa.binary()),
            ],
            ["part", "slice", "ranks", "marks"],
        )

    def answered(self, answers: list[dict]) -> np.ndarray:
        """For each value as given, what the answers to its slice say."""
        found = np.zeros(len(self.values), dtype=bool)
        for answer in answers:
            mine = self.order[self.bounds[answer["part"]] : self.bounds[answer["part"] + 1]]
            found[mine] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=len(mine)).astype(bool)
        return found[self.inverse]


def settle(size: int, step: int, counted: bool):
    """Answers of one range: which ranks occur again, or (not counted) which any slice has marked."""

    def run(table: pa.Table) -> pa.Table:
        ranks = table.column("ranks").to_pylist()
        counts = np.array([len(r) // size for r in ranks])
        padded = np.zeros((counts.sum(), 8), dtype=np.uint8)
        padded[:, :size] = np.frombuffer(b"".join(ranks), np.uint8).reshape(-1, size)
        marks = [
            np.unpackbits(np.frombuffer(m, np.uint8), count=n)
            for m, n in zip(table.column("marks").to_pylist(), counts.tolist())
        ]
        _, inverse, times = np.unique(padded.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        found = np.bincount(inverse, np.concatenate(marks)) > 0
        if counted:
            found |= times > 1
        found = found[inverse]
        edges = np.concatenate([[0], np.cumsum(counts)])
        bits = [np.packbits(found[b:e]).tobytes() for b, e in zip(edges[:-1], edges[1:])]
        rows = len(counts)
        return pa.table(
            {
                "slice": table.column("slice"),
                "step": pa.array(np.full(rows, step, np.int32)),
                "part": table.column("part"),
                "bits": pa.array(bits, pa.binary()),
            }
        )

    return run


ANSWERS = "slice long, step int, part int, bits binary"


def texts_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return raw_bytes(pa.array(row["texts"], pa.binary()))


def state_of(row: dict) -> list[np.ndarray]:
    return [np.frombuffer(row[c], kind).astype(np.int64 if kind != np.uint64 else kind) for c, kind in zip(STATE, KINDS)]


def of_step(row: dict, step: int) -> list[dict]:
    return [a for a in row["answers"] or [] if a["step"] == step]


def doubled(state: list[np.ndarray], row: dict, rounds: int, width: int, ranges: int):
    """The state after as many rounds: the next question (None at the end), and repeated spans."""
    pos, order, core, span, _, _ = state
    name, span, phrases = core.copy(), span.copy(), np.full(len(pos), 2)
    going = span < width
    for step in range(1, rounds + 2):
        at = np.flatnonzero(going)
        beyond = np.searchsorted(order, order[at] + phrases[at])
        has = np.append(order, -1)[beyond] == order[at] + phrases[at]
        going[at[~has]] = False
        at, beyond = at[has], beyond[has]
        if not len(at):
            return None, span
        pairs = mix(name[at] * TIMES + name[beyond])
        question = Question(pairs, ranges)
        if step > rounds:
            return question, span
        again = question.answered(of_step(row, step))
        going[at[~again]] = False
        at, beyond = at[again], beyond[again]
        longer = pos[beyond] + span[beyond] - pos[at], phrases[at] + phrases[beyond]
        name[at], span[at], phrases[at] = pairs[again], *longer
        going[at] = span[at] < width


def covered(size: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change)[:-1] > 0


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One slice at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield {c: batch.column(c)[at].as_py() if c not in ("ids", "texts") else batch.column(c)[at].values for c in batch.schema.names}


def first_ranks(width: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield Question(Anchors(*texts_of(row), width).names, ranges).rows(row["slice"], SHORT)

    return run


def survivors(width: int, ranges: int):
    """Anchors whose two phrases occur again: places, orders, ranks, lengths and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            anchors = Anchors(*texts_of(row), width)
            kept = np.flatnonzero(Question(anchors.names, ranges).answered(of_step(row, 0)))
            if not len(kept):
                continue
            columns = [anchors.pos, anchors.order, anchors.names, anchors.span, anchors.back, anchors.windows]
            data = [pa.array([c[kept].astype(kind).tobytes()], pa.binary()) for c, kind in zip(columns, KINDS)]
            yield pa.RecordBatch.from_arrays([pa.array([row["slice"]], pa.int64()), *data], ["slice", *STATE])

    return run


def next_ranks(rounds: int, width: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            question, _ = doubled(state_of(row), row, rounds, width, ranges)
            if question:
                yield question.rows(row["slice"], SHORT)

    return run


class Edges:
    """What the rounds leave: covered bytes, and the anchors with windows beyond them."""

    def __init__(self, row: dict, rounds: int, width: int, ranges: int):
        state = state_of(row)
        self.pos, _, self.core, _, self.back, self.count = state
        _, span = doubled(state, row, rounds, width, ranges)
        size = int((self.pos + np.maximum(span, width)).max()) + width
        done = span >= width
        self.mask = covered(size, self.pos[done], span[done])
        self.gone = np.concatenate([[0], np.cumsum(self.mask)])
        self.first = self.pos - self.back
        stop = self.first + self.count + width - 1
        has = self.count > 0
        inside = self.gone[np.where(has, stop, 0)] - self.gone[np.where(has, self.first, 0)]
        self.open = has & (inside < np.where(has, stop - self.first, 0))

    def question(self, ranges: int) -> Question:
        """Ask whether an anchor of the same two phrases is open anywhere."""
        return Question(self.core, ranges, marks=self.open)

    def windows(self, row: dict, step: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows to rank exactly, and the rank of their anchor."""
        wanted = self.question(ranges).answered(of_step(row, step)) & (self.count > 0)
        count = self.count[wanted]
        start = np.repeat(self.first[wanted], count)
        start += np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
        return start, np.repeat(self.core[wanted], count)


def open_ranks(rounds: int, width: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield Edges(row, rounds, width, ranges).question(ranges).rows(row["slice"], SHORT)

    return run


def exact_question(row: dict, edges: Edges, data: np.ndarray, step: int, width: int, ranges: int):
    start, core = edges.windows(row, step, ranges)
    names = rolling(data.astype(np.uint64) + np.uint64(1), width)[start] if len(start) else np.zeros(0, np.uint64)
    return start, Question(names, ranges, deal=mix(names ^ core * TIMES))


def exact_ranks(rounds: int, width: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            edges = Edges(row, rounds, width, ranges)
            _, question = exact_question(row, edges, texts_of(row)[0], rounds + 1, width, ranges)
            if len(question.values):
                yield question.rows(row["slice"], LONG)

    return run


def without_repeats(rounds: int, width: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            data, offsets = texts_of(row)
            gone = np.zeros(len(data), dtype=bool)
            if row["pos"]:
                edges = Edges(row, rounds, width, ranges)
                start, question = exact_question(row, edges, data, rounds + 1, width, ranges)
                again = question.answered(of_step(row, rounds + 2))
                size = min(len(data), len(edges.mask))
                gone[:size] = edges.mask[:size]
                gone |= covered(len(data), start[again], width)
            begins = np.concatenate([[0], np.cumsum(gone)])
            fresh = gone.copy()
            fresh[1:] &= ~gone[:-1]
            edge = offsets[offsets < len(data)]
            fresh[edge] = gone[edge]
            starts = np.flatnonzero(fresh)
            stops = gone.copy()
            stops[:-1] &= ~gone[1:]
            edge = offsets[offsets > 0] - 1
            stops[edge] = gone[edge]
            stops = np.flatnonzero(stops) + 1
            first = np.searchsorted(starts, offsets)
            base = np.repeat(offsets[:-1], np.diff(first))
            spans = pa.ListArray.from_arrays(
                pa.array(first.astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(starts - base), pa.array(stops - base)], ["start", "stop"]),
            )
            kept = blobs(data[~gone], offsets - begins[offsets])
            yield pa.RecordBatch.from_arrays(
                [row["ids"], pa.array(np.diff(offsets)), pa.array(np.diff(begins[offsets])), spans, kept],
                ["id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """The rows through a table bucketed by slice in the shared folder; joins by slice keep its order."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = "millrace_" + path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.format("parquet").option("path", path).bucketBy(buckets, "slice").saveAsTable(table)
    return spark.table(table)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: `id`, `n_bytes`, `n_removed`, `spans` (start, stop of removed runs) and `kept` bytes.

    A byte goes if a string of `width` bytes that covers it starts anywhere else too;
    strings are judged on the input, and bytes are those of the text in UTF-8.  The width
    is 3 at least, the least that holds an anchor and two phrases.
    """
    if width < 3:
        raise ValueError("The width is 3 bytes at least.")
    spark = ready(docs.sparkSession)
    source = renamed(docs, id=id_column, text=text_column).withColumn("text", text_of("text"))
    identity = source.schema["id"].dataType
    buckets = partitions(spark)
    ranges = 4 * buckets
    kind = T.StructType().add("slice", "long").add("ids", T.ArrayType(identity)).add("texts", T.ArrayType(T.BinaryType()))
    texts = bucketed(source.mapInArrow(slicing, kind), "slices", buckets)
    sent = "part int, slice long, ranks binary, marks binary"
    answers: list[DataFrame] = []

    def settled(asked: DataFrame, step: int, size: int = SHORT, counted: bool = True) -> bool:
        """Write the answers to a question of all slices; return whether there were any."""
        found = asked.groupBy("part").applyInArrow(settle(size, step, counted), ANSWERS)
        answers.append(written(found, f"answers-{step}"))
        return not answers[-1].isEmpty()

    def answered(df: DataFrame, last: int | None = None) -> DataFrame:
        """The slices with the answers they have got."""
        if not answers:
            return df.withColumn("answers", F.lit(None))
        known = answers[0] if last == 0 else answers[1]
        for more in answers[2:] if last is None else []:
            known = known.unionByName(more)
        per_slice = known.groupBy("slice").agg(F.collect_list(F.struct("step", "part", "bits")).alias("answers"))
        return df.join(per_slice, "slice", "left")

    settled(texts.select("slice", "texts").mapInArrow(first_ranks(width, ranges), sent), 0)
    fields = "slice long, " + ", ".join(f"{c} binary" for c in STATE)
    state = bucketed(
        answered(texts.select("slice", "texts"), 0).mapInArrow(survivors(width, ranges), fields), "anchors", buckets
    )
    rounds = 0
    current = state.withColumn("answers", F.lit(None).cast("array<struct<step:int,part:int,bits:binary>>"))
    while settled(current.mapInArrow(next_ranks(rounds, width, ranges), sent), rounds + 1):
        rounds += 1
        current = answered(state)
    settled(current.mapInArrow(open_ranks(rounds, width, ranges), sent), rounds + 1, counted=False)
    current = answered(state)
    exact = current.join(texts.select("slice", "texts"), "slice").mapInArrow(exact_ranks(rounds, width, ranges), sent)
    settled(exact, rounds + 2, LONG)
    result = (
        T.StructType().add("id", identity).add("n_bytes", "long").add("n_removed", "long")
        .add("spans", T.ArrayType(SPAN)).add("kept", "binary")
    )
    return texts.join(answered(state), "slice", "left").mapInArrow(without_repeats(rounds, width, ranges), result)
