"""Packing of tokenised texts into sequences of equal attention cost.

A piece of n tokens costs n plus n * n / QUADRATIC, linear layers and attention.  Within a
block of texts, full sequences are cut off long texts; the rest goes in descending length
to the cheapest sequence with room for it, and what fits nowhere is cut to fill the
cheapest sequences with room.  What is left below one full sequence becomes sequences
of powers of two, which need no padding.  A block is what one task has read, about
`BLOCK_TOKENS`, so nothing is shuffled and a task holds one block.

Tokens are looked up: the texts are cut at the places where the vocabulary's splitting
pattern cuts them, found with character classes in numpy, and each distinct piece goes
through the tokenizer once per worker.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import ready, renamed, text_of
from .text import prefix_sums, slices, span_hashes

LENGTH = 2048
END = 1
QUADRATIC = 4096
BLOCK_TOKENS = 1 << 21
KNOWN_PIECES = 1 << 20

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


def character_classes() -> np.ndarray:
    """The class of every code point in the splitting pattern of byte-level vocabularies."""
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(0x110000):
        category = unicodedata.category(chr(code))
        if category[0] == "L":
            classes[code] = LETTER
        elif category[0] == "N":
            classes[code] = NUMBER
    # White_Space of the Unicode property list, as `\\s` has it.
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    classes[spaces] = SPACE
    return classes


class Lookup:
    """Token ids of texts by a vocabulary file, each distinct piece tokenised once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_feed = self.encode(["\n"])[0]
        self.classes = character_classes()
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 18, dtype=np.int64)
        self.count = np.zeros(1 << 18, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many each has: one text of many lines, if the
        line feed is one token, since neither a blank nor anything else joins it."""
        blank = [p.isspace() for p in pieces]
        words = [p for p, b in zip(pieces, blank) if not b]
        encoded: list[np.ndarray] = []
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = self.encode(["\n".join(part)])[0]
            lines = np.split(ids, np.flatnonzero(ids == self.line_feed))
            lines = [lines[0], *[x[1:] for x in lines[1:]]]
            encoded += lines if len(self.line_feed) == 1 and len(lines) == len(part) else self.encode(part)
        others = iter(self.encode([p for p, b in zip(pieces, blank) if b]))
        ordered = iter(encoded)
        found = [next(others) if b else next(ordered) for b in blank]
        return np.concatenate(found), np.array([len(x) for x in found], dtype=np.int64)

    def cuts(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where pieces begin in the code points of texts without contractions."""
        kind = self.classes[codes]
        change = np.ones(len(codes), dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        change[edges] = True
        blank = kind == SPACE
        # The last space of a run belongs to what follows it, unless it ends the text:
        # a plain space joins the next piece, another one is a piece by itself.
        last = np.zeros(len(codes), dtype=bool)
        last[:-1] = blank[:-1] & ~blank[1:]
        ends = edges[edges > 0] - 1
        last[ends[ends < len(codes)]] = False
        change |= last
        after = np.flatnonzero(last & (codes == 0x20)) + 1
        change[after] = False
        return np.flatnonzero(change)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin."""
        plain = [t or "" for t in texts.to_pylist()]
        odd = [i for i, t in enumerate(plain) if self.irregular(t)]
        apart = dict(zip(odd, self.encode([plain[i] for i in odd]))) if odd else {}
        for i in odd:
            plain[i] = ""
        lengths = np.array([len(t) for t in plain], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        joined = "".join(plain)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ids, counts = np.zeros(0, np.uint32), np.zeros(len(plain), np.int64)
        if len(codes):
            cut = self.cuts(codes, offsets[:-1][lengths > 0])
            ends = np.append(cut[1:], len(codes))
            sums = prefix_sums(codes.astype(np.uint64) + np.uint64(1))
            names = span_hashes(sums, cut, ends)
            coded = pa.array(names).dictionary_encode()
            unique, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
            slots = self.slots(unique, which, cut, ends, joined)
            first, count = self.first[slots][which], self.count[slots][which]
            out = np.cumsum(count)
            source = np.arange(out[-1]) + np.repeat(first - (out - count), count)
            ids = self.ids[source]
            piece_of = np.searchsorted(cut, offsets)
            totals = np.concatenate([[0], out])
            counts = np.diff(totals[piece_of])
        if not odd:
            return ids, np.concatenate([[0], np.cumsum(counts)])
        begin = np.concatenate([[0], np.cumsum(counts)])
        parts = [apart.get(i, ids[begin[i] : begin[i + 1]]) for i in range(len(plain))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def irregular(self, text: str) -> bool:
        """Whether a text has contractions or special tokens, which the classes do not show."""
        return "'" in text or any(s in text for s in self.special)

    def slots(self, names: np.ndarray, which: np.ndarray, cut: np.ndarray, ends: np.ndarray, joined: str) -> np.ndarray:
        if len(self.known) + len(names) > KNOWN_PIECES:
            self.forget()
        get = self.known.get
        slots = np.array([get(n, -1) for n in names.tolist()], dtype=np.int64)
        fresh = np.flatnonzero(slots < 0)
        if not len(fresh):
            return slots
        at = np.zeros(len(names), dtype=np.int64)
        at[which[::-1]] = np.arange(len(which))[::-1]
        pieces = [joined[a:b] for a, b in zip(cut[at[fresh]].tolist(), ends[at[fresh]].tolist())]
        flat, sizes = self.encode_pieces(pieces)
        base = len(self.known)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while base + len(fresh) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[base : base + len(fresh)] = self.used + np.cumsum(sizes) - sizes
        self.count[base : base + len(fresh)] = sizes
        self.used += len(flat)
        self.known.update(zip(names[fresh].tolist(), range(base, base + len(fresh))))
        slots[fresh] = np.arange(base, base + len(fresh))
        return slots


_lookups: dict[str, Lookup] = {}


def lookup(path: str) -> Lookup:
    """The lookup of this worker for a vocabulary file."""
    if path not in _lookups:
        _lookups[path] = Lookup(path)
    return _lookups[path]


def production_vocabulary() -> str:
    """The place of the production vocabulary file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cost(length: int) -> float:
    return length + length * length / QUADRATIC


def packed(sizes: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (text, start, size, sequence, offset) for texts of these sizes.

    All sequences but the last few are full; those have powers of two.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    sequence = 0
    for text, size in enumerate(sizes):
        start = 0
        while size - start >= length:
            pieces.append((text, start, length, sequence, 0))
            sequence, start = sequence + 1, start + length
        if size > start:
            rest.append((size - start, text, start))
    rest.sort(key=lambda r: (-r[0], r[1]))
    tokens = sum(r[0] for r in rest)
    room = [length] * (tokens // length)
    short = tokens % length
    room += [1 << bit for bit in reversed(range(short.bit_length())) if short >> bit & 1]
    used, charge = [0] * len(room), [0.0] * len(room)
    # Sequences by room left, each a heap by cost: the cheapest with room enough is found
    # among the heads of the heaps.
    classes: list[list[tuple[float, int, int]]] = [[] for _ in range(length.bit_length() + 1)]
    for i, size in enumerate(room):
        heapq.heappush(classes[size.bit_length()], (0.0, i, size))

    def place(text: int, start: int, size: int, i: int) -> None:
        pieces.append((text, start, size, sequence + i, used[i]))
        used[i] += size
        room[i] -= size
        charge[i] += cost(size)
        if room[i]:
            heapq.heappush(classes[room[i].bit_length()], (charge[i], i, room[i]))

    for size, text, start in rest:
        best = None
        for heap in classes[size.bit_length() + 1 :]:
            if heap and (best is None or heap[0] < best[0]):
                best = (heap[0], heap)
        # In the class of the size itself some have room enough and some have not.
        same = classes[size.bit_length()]
        fit = min((entry for entry in same if entry[2] >= size), default=None)
        if fit is not None and (best is None or fit < best[0]):
            same.remove(fit)
            heapq.heapify(same)
            place(text, start, size, fit[1])
        elif best is not None:
            heapq.heappop(best[1])
            place(text, start, size, best[0][1])
        else:
            while size:
                heap = next(h for h in reversed(classes) if h)
                i = heapq.heappop(heap)[1]
                part = min(size, room[i])
                place(text, start, part, i)
                start, size = start + part, size - part
    return pieces


def pack_rows(path: str, length: int, end: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lookup(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36
        held_ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, total
            lengths = np.concatenate(sizes)
            tokens = np.concatenate(held)
            pieces = np.array(packed(lengths.tolist(), length), dtype=np.int64).reshape(-1, 5)
            text, start, size, own, offset = pieces.T
            begin = (np.cumsum(lengths) - lengths)[text] + start
            data = memoryview(tokens.tobytes())
            checks = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), size.tolist())]
            out_ids = [tokens[a : a + n] for a, n in zip(begin.tolist(), size.tolist())]
            flat = np.concatenate(out_ids).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat)
            )
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(held_ids).take(pa.array(text)), pa.array(start), pa.array(size), lists,
                    pa.array(np.array(checks, dtype=np.int64)), pa.array(lengths[text]),
                    pa.array(own + sequence), pa.array(offset),
                ],
                ["id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += int(own.max()) + 1
            held_ids.clear(), held.clear(), sizes.clear()
            total = 0
            return batch

        for batch in slices(batches, "text", 1 << 20):
            ids, first = found.tokens(batch.column("text"))
            counts = np.diff(first)
            with_end = np.full(len(ids) + len(counts), end, dtype=np.uint32)
            body = np.ones(len(with_end), dtype=bool)
            body[np.cumsum(counts + 1) - 1] = False
            with_end[body] = ids
            held_ids.append(batch.column("id"))
            held.append(with_end)
            sizes.append(counts + 1)
            total += len(with_end)
            if total >= block_tokens:
                yield flush()
        if held:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = LENGTH,
    end: int = END,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Per piece: `id`, `start`, `length`, `ids`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`.

    A document is its ids by the vocabulary file and then `end`; null text is empty.  A
    piece is a run of its ids in one sequence of at most `length`, a power of two.  Null
    ids and repeated rows are packed like others.  Sequence ids begin at partition * 2**36.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("The sequence length is a power of two.")
    ready(docs.sparkSession)
    source = renamed(docs, id=id_column, text=text_column).withColumn("text", text_of("text"))
    schema = T.StructType([source.schema["id"]]).add("start", "long").add("length", "long").add("ids", T.ArrayType(T.IntegerType()))
    for name in ("ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    return source.mapInArrow(pack_rows(vocabulary, length, end, block_tokens), schema)
