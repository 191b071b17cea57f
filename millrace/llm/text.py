"""Words, hashes and windows of whole Arrow text columns, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  All hashes are polynomial
(Rabin-Karp) over 64-bit wrap-around arithmetic with an odd base, followed by a
bijective mix; sums over any span come from one prefix sum and an inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 4 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0 .. base ** (count - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        known = np.full(max(count, 1 << 16), base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if count <= 1 << 24:
            _powers[base] = known
    return known[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(33))
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the sequence whose prefix sums are given."""
    length = (ends - starts).astype(np.uint64)
    raw = (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
    return mix(raw + length * np.uint64(0xA0761D6478BD642F))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` consecutive values."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix_sums(values)
    return mix((sums[width:] - sums[:-width]) * powers(INVERSE, count))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    count, covered, least = len(values) - width + 1, 1, values
    if count <= 0:
        return values[:0]
    while covered * 2 <= width:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    return np.minimum(least[:count], least[width - covered : width - covered + count])


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each text begins; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of several texts: byte spans, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, lower: bool = False) -> "Words":
        data, offsets = raw_bytes(texts)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        if not len(data):
            none = np.zeros(0, np.int64)
            return cls(data, none, none, np.zeros(len(offsets), np.int64))
        solid = ~BLANK[data]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = solid[edges]
        stops[edges - 1] = solid[edges - 1]
        starts = np.flatnonzero(begins)
        return cls(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(prefix_sums(self.data.astype(np.uint64) + np.uint64(1)), self.starts, self.ends)

    def fits(self, width: int) -> np.ndarray:
        """For each position with `width` words from it on: whether they are of one text."""
        count = max(0, len(self) - width + 1)
        ends = np.repeat(self.first[1:], self.counts())[:count]
        return np.arange(count) + width <= ends

    def joined(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each text joined by single spaces: bytes and text offsets."""
        starts, lengths = self.starts[kept], (self.ends - self.starts)[kept] + 1
        first = np.concatenate([[0], np.cumsum(kept)])[self.first]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        if not len(starts):
            return np.zeros(0, np.uint8), np.zeros(len(self.first), np.int64)
        source = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
        padded = np.append(self.data, np.uint8(0x20))
        out = padded[source]
        out[offsets[1:] - 1] = 0x20
        return out, offsets[first]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; one long text stays whole."""
    for batch in batches:
        _, offsets = raw_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def groups(batches: Iterator[pa.RecordBatch], key: str, limit: int = 16 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by `key`, of about `limit` bytes or one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        values = table.column(key).to_numpy()
        cut = int(np.searchsorted(values, values[-1], side="left"))
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, size = rest.to_batches(), rest.nbytes
            limit = max(limit, 2 * size) if size > limit else limit
        else:
            limit *= 2  # one group fills it all; look again when twice as much is there
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def blobs(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from bytes and offsets."""
    offsets = np.ascontiguousarray(offsets, dtype=np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )
