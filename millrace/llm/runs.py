"""Periodic runs of words by a suffix automaton with link-cut access, and their collapse.

A run is a stretch of words with smallest period q, of at least `max(least, copies * q)`
words, that no neighbouring word extends keeping period q.  For each stretch of a text the
suffix automaton of its words is built; its suffix links form a tree, kept as a link-cut
tree whose preferred paths are segments of nodes with one last end.  Appending a word
accesses its state: every segment on the way to the root gives the longest suffix that
ended at an earlier place, and the whole path takes the new end.  Where the distance q of
the two ends is within that length there is a square of period q, which is extended to
both sides as far as words q apart agree.

Only words that can be in a run enter an automaton: in a run of period q all words but the
last q recur within q words, so at least `(copies - 1) * q` words in a row do.  For each
power of two, stretches of fewer such words in a row hold no run of that many words'
period and are passed over; no run is lost.

The work is per text, inside the tasks of the scan; nothing is shuffled.  Null and empty
texts have no words and no runs.  A very long text is one Python loop over its periodic
stretches.  Repeated rows are judged each by itself.  Words are told apart by 64-bit
hashes.  Columns other than id and text do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import ready, renamed, text_of
from .text import Words, blobs, slices

LEAST = 6
COPIES = 4

RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


def suffix_automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and suffix link of each state, and the state of each prefix; state 0 is the root."""
    length, link, moves = [0], [-1], [{}]
    last, prefixes = 0, []
    for c in word:
        state = len(length)
        length.append(length[last] + 1)
        link.append(0)
        moves.append({})
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = state
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[to] == length[at] + 1:
                link[state] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                moves.append(moves[to].copy())
                link[to] = link[state] = copy
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = link[at]
        last = state
        prefixes.append(state)
    return length, link, prefixes


class LastEnds:
    """A link-cut tree over suffix links: each preferred path has one last end.

    Paths are splay trees ordered by depth; `end` is the colour of a node, `lazy` one still
    to be handed to the nodes below it.  Nodes are numbered from 1, 0 is none.
    """

    def __init__(self, link: list[int]):
        size = len(link) + 1
        self.up = [0] + [x + 1 for x in link]
        self.shallow, self.deep = [0] * size, [0] * size
        self.end, self.lazy = [-1] * size, [-1] * size

    def splay(self, x: int) -> None:
        """Bring `x` to the top of its path's tree."""
        up, shallow, deep, end, lazy = self.up, self.shallow, self.deep, self.end, self.lazy
        above = [x]
        y, top = x, up[x]
        while top and (shallow[top] == y or deep[top] == y):
            above.append(top)
            y, top = top, up[top]
        for y in reversed(above):
            colour = lazy[y]
            if colour >= 0:
                for z in (shallow[y], deep[y]):
                    if z:
                        end[z] = lazy[z] = colour
                lazy[y] = -1
        left = len(above) - 1
        while left:
            y = up[x]
            if left > 1:
                z = up[y]
                self.rotate(y if (shallow[y] == x) == (shallow[z] == y) else x)
                left -= 1
            self.rotate(x)
            left -= 1

    def rotate(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        y = up[x]
        z = up[y]
        if shallow[y] == x:
            moved = deep[x]
            shallow[y], deep[x] = moved, y
        else:
            moved = shallow[x]
            deep[y], shallow[x] = moved, y
        if moved:
            up[moved] = y
        up[y], up[x] = x, z
        if z:
            if shallow[z] == y:
                shallow[z] = x
            elif deep[z] == y:
                deep[z] = x

    def access(self, state: int, place: int, length: list[int]) -> list[tuple[int, int]]:
        """Recolour the path from `state` to the root; return (last end, length) of its segments."""
        found = []
        x, below = state + 1, 0
        while x:
            self.splay(x)
            if self.end[x] >= 0:
                found.append((self.end[x], length[x - 1]))
            self.deep[x] = below
            below, x = x, self.up[x]
        self.end[below] = self.lazy[below] = place
        return found


def stretches(words: np.ndarray, least: int, copies: int) -> list[tuple[int, int]]:
    """Disjoint stretches of one text that hold every run; most texts have none."""
    n = len(words)
    if n < least:
        return []
    order = np.argsort(words, kind="stable")
    again = np.full(n, n, dtype=np.int64)
    same = words[order[1:]] == words[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    found = []
    near = 1
    while copies * near <= n or near == 1:
        # Periods near to 2 * near - 1: their words but the last period recur that soon.
        soon = np.concatenate([[False], again < 2 * near, [False]])
        edges = np.flatnonzero(soon[1:] != soon[:-1])
        begin, end = edges[::2], edges[1::2]
        enough = end - begin >= max(least - (2 * near - 1), (copies - 1) * near, 1)
        found += [(b, min(n, e + 2 * near - 1)) for b, e in zip(begin[enough].tolist(), end[enough].tolist())]
        near *= 2
    merged: list[tuple[int, int]] = []
    for b, e in sorted(found):
        if merged and b < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((b, e))
    return merged


def extended(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The widest [start, stop) around place `at` in which words a period apart agree."""
    step, stop = 64, at + 1
    while True:
        part = words[stop : stop + step]
        other = np.flatnonzero(part != words[stop - period : stop - period + len(part)])
        if len(other) or len(part) < step:
            stop += int(other[0]) if len(other) else len(part)
            break
        stop, step = stop + step, 2 * step
    step, start = 64, at - period + 1
    while start:
        low = max(0, start - step)
        other = np.flatnonzero(words[low:start] != words[low + period : start + period])
        if len(other):
            start = low + int(other[-1]) + 1
            break
        start, step = low, 2 * step
    return start, stop


def runs_of(words: np.ndarray, least: int = LEAST, copies: int = COPIES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one text by start, then period."""
    best: dict[tuple[int, int], int] = {}
    for low, high in stretches(words, least, copies):
        _, names = np.unique(words[low:high], return_inverse=True)
        length, link, prefixes = suffix_automaton(names.tolist())
        ends = LastEnds(link)
        known: dict[int, int] = {}  # of each period, where the last square's stretch stops
        for place, state in enumerate(prefixes):
            for end, size in ends.access(state, place, length):
                period = place - end
                if 0 < period <= size and known.get(period, 0) <= low + place:
                    start, stop = extended(words, low + place, period)
                    known[period] = stop
                    if stop - start >= max(least, copies * period):
                        best[start, stop] = min(period, best.get((start, stop), period))
    return sorted((start, stop - start, period) for (start, stop), period in best.items())


def collapsing(least: int, copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words.of(batch.column("text"))
            hashes = words.hashes()
            kept = np.ones(len(words), dtype=bool)
            found: list[tuple[int, int, int]] = []
            counts = [0]
            for first, stop in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                runs = runs_of(hashes[first:stop], least, copies)
                for start, length, period in runs:
                    kept[first + start + period : first + start + length] = False
                found += runs
                counts.append(len(found))
            data, offsets = words.joined(kept)
            lengths = np.diff(offsets)
            keep = np.ones(len(data), dtype=bool)
            keep[offsets[1:][lengths > 0] - 1] = False
            tight = np.concatenate([[0], np.cumsum(lengths - (lengths > 0))])
            flat = [pa.array([r[i] for r in found], pa.int64()) for i in range(3)]
            runs = pa.ListArray.from_arrays(
                pa.array(counts, pa.int32()), pa.StructArray.from_arrays(flat, ["start", "length", "period"])
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(words.counts(), pa.int64()),
                    runs,
                    blobs(data[keep], tight).cast(pa.string()),
                ],
                ["id", "n_words", "runs", "text"],
            )

    return run


def collapse_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, copies: int = COPIES
) -> DataFrame:
    """Per row: `id`, `n_words`, `runs` (start, length, period; by start, then period) and `text`.

    The text keeps, joined by one space, the words that no run contains after its first
    period.
    """
    ready(docs.sparkSession)
    source = renamed(docs, id=id_column, text=text_column).withColumn("text", text_of("text"))
    result = (
        T.StructType().add("id", source.schema["id"].dataType).add("n_words", "long")
        .add("runs", T.ArrayType(RUN)).add("text", "string")
    )
    return source.mapInArrow(collapsing(least, copies), result)
