"""Removal of word passages that occur more than once, by Rabin-Karp window hashes.

Every window of `width` consecutive words of one text is hashed.  Equal windows share
their anchor, the least hash among the `GRAM`-word spans inside, so windows are shuffled
by anchor, as one row per run of windows with the same anchor: a third of the bytes of
one row a window.  Counting happens per anchor; repeated windows merge to intervals,
and a text loses every word such an interval covers.

Anchors of more than `HEAVY_ROWS` runs (at most `HEAVY_LIST` of them, so the list is
bounded) are dealt by window instead, and copies within one Arrow batch are settled there
and sent once, so a passage in a third of all texts is not one task.  A window is told
apart by its 64-bit anchor and 48 bits of its hash.

Null and empty texts have no words and lose none.  A row repeated in full counts as two
occurrences.  Rows are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import partitions, ready, renamed, text_of
from .text import Words, blobs, groups, mix, prefix_sums, rolling, slices, sliding_min, span_hashes

WIDTH = 35
GRAM = 6
HEAVY_ROWS = 4096
HEAVY_LIST = 1 << 20
HASH_BYTES = 6


def window_runs(batch: pa.RecordBatch, width: int, heavy: np.ndarray | None = None):
    """Runs of windows with one anchor: words, window hashes, run bounds and anchors."""
    gram = min(GRAM, width)
    words = Words.of(batch.column("text"))
    position = np.flatnonzero(words.fits(width))
    if not len(position):
        return None
    hashes = words.hashes()
    windows = rolling(hashes, width)[position]
    anchors = sliding_min(rolling(hashes, gram), width - gram + 1)[position]
    text = words.text_of_word()[position]
    fresh = np.ones(len(position), dtype=bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
    dealt = None
    if heavy is not None and len(heavy):
        at = np.minimum(np.searchsorted(heavy, anchors), len(heavy) - 1)
        dealt = heavy[at] == anchors
        fresh |= dealt
        fresh[1:] |= dealt[:-1]
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(position))
    return words, position, windows, anchors, text, begin, end, dealt


def anchor_keys(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = window_runs(batch, width)
            if found:
                anchors, begin = found[3], found[5]
                yield pa.RecordBatch.from_arrays([pa.array(anchors[begin].view(np.int64))], ["key"])

    return run


def run_rows(width: int, heavy_list):
    """Rows (key, row, start, n, hashes); without hashes, windows already known as repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = heavy_list.value
        for batch in slices(batches, "text"):
            found = window_runs(batch, width, heavy)
            if not found:
                continue
            words, position, windows, anchors, text, begin, end, dealt = found
            rows = batch.column("row").to_numpy()[text[begin]]
            starts = (position - words.first[text])[begin].astype(np.int32)
            counts = (end - begin).astype(np.int32)
            keys = anchors[begin]
            if dealt is not None:
                keys = np.where(dealt[begin], mix(anchors ^ windows)[begin], keys)
            alike = mix(keys ^ mix(span_hashes(prefix_sums(windows), begin, end)))
            _, first, inverse, copies = np.unique(alike, return_index=True, return_inverse=True, return_counts=True)
            known = np.flatnonzero(copies[inverse] > 1)
            sent = np.sort(first)
            flags = np.zeros(len(begin), dtype=bool)
            flags[sent] = True
            tail = windows.view(np.uint8).reshape(-1, 8)[np.repeat(flags, counts), 8 - HASH_BYTES :]
            offsets = np.concatenate([[0], np.cumsum(counts[sent].astype(np.int64) * HASH_BYTES)])
            offsets = np.concatenate([offsets, np.full(len(known), offsets[-1])])
            both = np.concatenate([sent, known])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([keys[sent].view(np.int64), rows[known]])),
                    pa.array(rows[both]),
                    pa.array(starts[both]),
                    pa.array(counts[both]),
                    blobs(tail, offsets),
                ],
                ["key", "row", "start", "n", "hashes"],
            )

    return run


def repeated(keys: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each window, whether another of the same key has its hash; keys are sorted."""
    group = np.zeros(len(keys), dtype=np.int64)
    group[1:] = np.cumsum(keys[1:] != keys[:-1])
    padded = np.zeros((len(hashes), 8), dtype=np.uint8)
    padded[:, :HASH_BYTES] = hashes
    values = padded.view(np.uint64).ravel()
    of_window = np.repeat(group, counts)
    found = np.zeros(len(values), dtype=bool)
    span = 1 << (64 - 8 * HASH_BYTES)
    edges = np.searchsorted(of_window, np.arange(0, group[-1] + 1 + span, span)) if len(values) else []
    for low, high in zip(edges[:-1], edges[1:]):
        inner = (of_window[low:high] % span).astype(np.uint64)
        codes = (inner << np.uint64(8 * HASH_BYTES)) | values[low:high]
        order = np.argsort(codes)
        same = codes[order[1:]] == codes[order[:-1]]
        twin = np.zeros(len(codes), dtype=bool)
        twin[1:] = same
        twin[:-1] |= same
        found[low + order[twin]] = True
    return found


def repeated_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals (row, start, stop) of window positions, from runs sorted by key."""
    for table in groups(batches, "key"):
        keys, rows, starts, counts = (table.column(c).to_numpy() for c in ("key", "row", "start", "n"))
        column = table.column("hashes").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        open_runs = np.diff(offsets) > 0
        n = np.where(open_runs, counts, 0)
        mask = repeated(keys, n, data.reshape(-1, HASH_BYTES))
        run = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(mask)) - np.repeat(np.cumsum(n) - n, n)
        begins, stops = mask.copy(), mask.copy()
        joined = mask[1:] & mask[:-1] & (run[1:] == run[:-1])
        begins[1:] &= ~joined
        stops[:-1] &= ~joined
        known = np.flatnonzero(~open_runs)
        at = run[begins]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([rows[at], rows[known]])),
                pa.array(np.concatenate([starts[at] + place[begins], starts[known]]).astype(np.int32)),
                pa.array(
                    np.concatenate([starts[at] + place[stops] + 1, starts[known] + counts[known]]).astype(np.int32)
                ),
            ],
            ["row", "start", "stop"],
        )


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text compressed, for the shuffle."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        packed = pa.array([squeeze(x or b"") for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), packed], ["id", "row", "packed"])


def without_spans(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            texts = pa.array([expand(x) for x in whole.column("packed").to_pylist()], pa.large_binary())
            columns = [whole.column("id"), whole.column("spans"), texts]
            for batch in slices([pa.RecordBatch.from_arrays(columns, ["id", "spans", "text"])], "text"):
                words = Words.of(batch.column("text"))
                spans = batch.column("spans")
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                flat = spans.flatten()
                owner = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
                if len(flat):
                    start, stop = (np.asarray(x) for x in flat.flatten())
                    np.add.at(cover, words.first[owner] + start, 1)
                    np.add.at(cover, words.first[owner] + stop + width - 1, -1)
                kept = np.cumsum(cover)[:-1] == 0
                removed = np.concatenate([[0], np.cumsum(~kept)])[words.first]
                data, offsets = words.joined(kept)
                lengths = np.diff(offsets)
                # The last space of each text goes: one byte less where there are words.
                keep = np.ones(len(data), dtype=bool)
                keep[offsets[1:][lengths > 0] - 1] = False
                tight = np.concatenate([[0], np.cumsum(lengths - (lengths > 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array(words.counts(), pa.int64()),
                        pa.array(np.diff(removed), pa.int64()),
                        blobs(data[keep], tight).cast(pa.string()),
                    ],
                    ["id", "n_words", "n_removed", "text"],
                )

    return run


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: `id`, `n_words`, `n_removed` and `text`, the kept words joined by one space.

    A word goes if some window of `width` words that covers it occurs anywhere else too;
    windows are judged on the input.
    """
    spark = ready(docs.sparkSession)
    source = renamed(docs, id=id_column, text=text_column).withColumn("text", text_of("text"))
    source = source.withColumn("row", F.xxhash64("id", "text"))
    identity = source.schema["id"].dataType
    heavy = (
        source.select("text").mapInArrow(anchor_keys(width), "key long").groupBy("key").count()
        .where(F.col("count") > HEAVY_ROWS).orderBy(F.desc("count"), "key").limit(HEAVY_LIST)
        .select("key").toArrow().column("key").to_numpy().view(np.uint64)
    )
    runs = source.select("row", "text").mapInArrow(
        run_rows(width, spark.sparkContext.broadcast(np.sort(heavy))),
        "key long, row long, start int, n int, hashes binary",
    )
    spans = (
        runs.repartition(partitions(spark), "key").sortWithinPartitions("key")
        .mapInArrow(repeated_spans, "row long, start int, stop int")
        .groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    )
    packed = source.select("id", "row", "text").mapInArrow(
        pack_texts, T.StructType().add("id", identity).add("row", "long").add("packed", "binary")
    )
    result = T.StructType().add("id", identity).add("n_words", "long").add("n_removed", "long").add("text", "string")
    return packed.join(spans, "row", "left").select("id", "spans", "packed").mapInArrow(without_spans(width), result)
