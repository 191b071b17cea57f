"""Jaccard self-join of n-gram sets with a prefix tree, and its connected components.

A text's set is its distinct shingles of `words` words.  Equal sets are one set.  Two
linked sets of sizes a and b differ in at most d = (a + b)(1 - t)/(1 + t) shingles, so
when the hash range is cut in more than d parts, some part is equal in both.  Sets that
share a part are candidates of one another, found from one light row per part.  Pairs
whose outlines - shingle counts by hash range - already differ by more than d are dropped,
which loses no link; the components of the others are the units of the join.  A text
travels once, to its unit.

In a unit the sets are ordered by one global order (frequent shingles first, then by
hash) and stored in a trie.  A traversal in depth-first order keeps the partial overlap
of every set with the path so far, shared by all sets below it, and drops sets that can
no longer reach the threshold with the shingles remaining.

A part that is empty proves nothing; sets with as many empty parts as there are sure
equal ones take part with their prefix shingles as well, so no link is lost.  How many are
sure follows from the set's own size; where they are several, that many less one are left
out, those with the fewest shingles, which unlike texts with a common line share.  A unit of
more than `UNIT_TOKENS` shingles is cut in blocks, and every pair of blocks is a task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import partitions, ready, renamed, same_row, text_of, with_row_keys, with_row_name, written
from .graph import components
from .text import Words, blobs, groups, mix, prefix_sums, rolling, slices, span_hashes

WORDS = 3
PERCENT = 90
UNIT_TOKENS = 1 << 17
MOST_COUNTED = 15  # of an outline's range, four bits


def most_differing(total, percent: int):
    """Most shingles in which two linked sets of `total` shingles together may differ."""
    return total * (100 - percent) // (100 + percent)


@functools.cache
def part_plan(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The part counts in use, each at most 1.6 times the one before, and for each the most
    shingles two sets may differ in: the parts that are surely equal then outnumber the empty
    parts to be expected in sets of that size, but for rare sets."""
    counts = [1]
    while counts[-1] < 1 << 30:
        counts.append(max(counts[-1] + 1, counts[-1] * 8 // 5))
    parts = np.array(counts, dtype=np.int64)
    filling = (100 + percent) / (2 * (100 - percent))  # shingles a part, about
    empty = parts * np.exp(-filling)
    spare = np.where(empty < 5e-4, 0, np.ceil(empty + 4 * np.sqrt(empty))).astype(np.int64)
    return parts, np.maximum.accumulate(parts - 1 - spare)


def outline_bits(sizes: np.ndarray) -> np.ndarray:
    return np.maximum(np.ceil(np.log2(np.maximum(sizes, 1) / 8)), 3).astype(np.int64)


def outline_counts(outline: bytes) -> np.ndarray:
    pairs = np.frombuffer(outline, np.uint8)
    return np.column_stack([pairs & 15, pairs >> 4]).ravel().astype(np.int32)


def fullest(text: np.ndarray, fill: np.ndarray, filled: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places of the `most` parts of each text with the most shingles, the lower numbered first.

    Parts come by text, then number; `filled` counts them.  The order is one order of all
    parts, so of s parts that two texts have in common the first is kept by each that
    leaves out less than s.
    """
    order = np.argsort(text << np.int64(32) | (np.int64(1 << 31) - fill), kind="stable")
    place = np.arange(len(text)) - np.repeat(np.cumsum(filled) - filled, filled)
    return np.sort(order[place < most[text]])


class Sets:
    """The sorted distinct shingle hashes of several texts."""

    def __init__(self, texts: pa.Array, words: int):
        found = Words.of(texts, lower=True)
        hashes = found.hashes()
        sums, counts = prefix_sums(hashes), found.counts()
        position = np.flatnonzero(found.fits(words))
        shingles = rolling(hashes, words)[position] if len(position) else np.zeros(0, np.uint64)
        per_text = np.maximum(counts - words + 1, 0)
        short = np.flatnonzero((counts > 0) & (counts < words))
        whole = span_hashes(sums, found.first[short], found.first[short + 1])
        lengths = per_text.copy()
        lengths[short] = 1
        ends = np.cumsum(lengths)
        values = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint64)
        single = np.zeros(len(values), dtype=bool)
        single[ends[short] - 1] = True
        values[single], values[~single] = whole, shingles
        for low, high in zip((ends - lengths).tolist(), ends.tolist()):
            if high - low > 1:
                values[low:high].sort()
        text = np.repeat(np.arange(len(lengths)), lengths)
        fresh = np.ones(len(values), dtype=bool)
        fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        self.values, self.text = values[fresh], text[fresh]
        self.sizes = np.bincount(self.text, minlength=len(lengths))
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])

    def ids(self) -> np.ndarray:
        """One 64-bit name for each set, from its members alone."""
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.values ^ np.uint64(0x5851F42D4C957F2D)))])
        return mix((sums[self.first[1:]] - sums[self.first[:-1]]) ^ self.sizes.astype(np.uint64)).view(np.int64)

    def outlines(self) -> pa.Array:
        """How many shingles fall in each of about size / 6 ranges of the hash, 15 at most,
        two counts to a byte.

        Two sets differ in no less than their outlines do, however these are folded.
        """
        bits = outline_bits(self.sizes)
        ends = np.cumsum(np.int64(1) << bits)
        begin = np.concatenate([[0], ends])[:-1]
        place = (self.values >> (np.uint64(64) - bits[self.text].astype(np.uint64))).astype(np.int64)
        counts = np.bincount(begin[self.text] + place, minlength=int(ends[-1]) if len(ends) else 0)
        low, high = np.minimum(counts, MOST_COUNTED).astype(np.uint8).reshape(-1, 2).T
        return blobs(low | high << np.uint8(4), np.concatenate([[0], ends // 2]))

    def keys(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all parts a linked set could share, and the text of each."""
        sizes, first = self.sizes, self.first
        largest = sizes * 100 // percent
        plan, allowed = part_plan(percent)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.values))])
        keys, texts = [], []
        needs_prefix = np.zeros(len(sizes), dtype=bool)
        differing = most_differing(sizes + largest, percent)
        # Sets this small are linked with equal sets only, which are one set already.
        open_sets = (sizes > 0) & (differing > 0)
        # The larger set of a pair decides on the parts; it may be as large as `largest`.
        least = np.searchsorted(allowed, most_differing(2 * sizes, percent))
        most = np.searchsorted(allowed, most_differing(2 * largest, percent))
        for step in range(int((most - least)[open_sets].max(initial=-1)) + 1):
            chosen = open_sets & (least + step <= most)
            parts = plan[least + step]
            at = np.flatnonzero(chosen[self.text])
            text = self.text[at]
            part = ((self.values[at] >> np.uint64(32)) * parts[text].astype(np.uint64)) >> np.uint64(32)
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (text[1:] != text[:-1]) | (part[1:] != part[:-1])
            begin = np.flatnonzero(fresh)
            end = np.append(begin[1:], len(at))
            content = sums[at[end - 1] + 1] - sums[at[begin]]
            name = mix(parts[text[begin]].astype(np.uint64) << np.uint64(32) | part[begin])
            filled = np.bincount(text[begin], minlength=len(sizes))
            # Equal parts with shingles: with any linked set there are as many at least.
            sure = filled - np.minimum(allowed[least + step], differing)
            needs_prefix |= chosen & (sure <= 0)
            kept = fullest(text[begin], end - begin, filled, np.where(chosen, filled - np.maximum(sure - 1, 0), 0))
            keys.append(mix(content ^ name)[kept])
            texts.append(text[begin][kept])
        if needs_prefix.any():
            length = sizes - -(-sizes * percent // 100) + 1
            place = np.arange(len(self.values)) - first[self.text]
            at = np.flatnonzero(needs_prefix[self.text] & (place < length[self.text]))
            keys.append(mix(self.values[at] ^ np.uint64(0x14057B7EF767814F)))
            texts.append(self.text[at])
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(keys), np.concatenate(texts)


def signature_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = Sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sets.ids()), pa.array(sets.sizes.astype(np.int64)), sets.outlines()],
                ["id", "set", "n", "outline"],
            )

    return run


ASKED, SHARED, KNOWN = range(3)
KEY_BYTES = 6
LOW_BYTES = np.uint64((1 << 8 * KEY_BYTES) - 1)
LEAST_RANGES = 64  # so that a set's rows do not grow with the partitions of small clusters


def candidate_rows(words: int, percent: int, ranges: int):
    """Rows (range, kind, sets, counts, keys): the sets of a slice with keys in a range, how many
    each has, and these in a row, each once a slice.

    There is one row a slice, range and kind, so rows do not grow with the sets' keys.  Of
    the sets of a slice that share a key one asks for it, marked as shared; that the others
    share it is known, so a key of very many sets is asked for once a slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = Sets(batch.column("text"), words)
            keys, texts = sets.keys(percent)
            if not len(keys):
                continue
            nodes = sets.ids()
            _, first = np.unique(nodes, return_index=True)
            once = np.zeros(len(nodes), dtype=bool)
            once[first] = True
            keys, texts = keys[once[texts]], texts[once[texts]]
            order = np.lexsort((texts, keys))
            keys, texts = keys[order], texts[order]
            again = np.append(False, keys[1:] == keys[:-1])
            fresh = ~(again & np.append(False, texts[1:] == texts[:-1]))
            keys, texts, again = keys[fresh], texts[fresh], again[fresh]
            kind = np.where(again, KNOWN, ASKED)
            kind[np.flatnonzero(again[1:] & ~again[:-1])] = SHARED
            own = nodes[texts]
            # Known keys go where their set is dealt, not all to the range of a common key.
            part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            to = np.where(kind == KNOWN, own.view(np.uint64) % np.uint64(ranges), part).astype(np.int64)
            # The range takes the place of the upper bytes; rows that go to it leave it out.
            keys = keys & LOW_BYTES | part << np.uint64(8 * KEY_BYTES)
            order = np.lexsort((texts, kind, to))
            keys, texts, own, to, kind = (x[order] for x in (keys, texts, own, to, kind))
            apart = np.append(True, (to[1:] != to[:-1]) | (kind[1:] != kind[:-1]))
            row = np.flatnonzero(apart)
            begin = np.flatnonzero(apart | np.append(True, texts[1:] != texts[:-1]))
            counts = np.diff(np.append(begin, len(keys))).astype(np.int32)
            edges = np.append(np.searchsorted(begin, row), len(begin))
            sent = keys.view(np.uint8).reshape(-1, 8)
            whole = np.repeat(kind == KNOWN, 8).reshape(-1, 8)
            whole[:, :KEY_BYTES] = True
            ends = np.concatenate([[0], np.cumsum(np.where(kind == KNOWN, 8, KEY_BYTES))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(to[row].astype(np.int32)), pa.array(kind[row].astype(np.int8)),
                    blobs(own[begin].view(np.uint8), edges * 8), blobs(counts.view(np.uint8), edges * 4),
                    blobs(sent[whole], ends[np.append(row, len(keys))]),
                ],
                ["to", "kind", "sets", "counts", "keys"],
            )

    return run


CANDIDATES = "to int, kind byte, sets binary, counts binary, keys binary"


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, set) of the keys that more than one set has, from the rows of whole ranges."""

    def joined(rows: pa.Table, column: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(column).to_pylist()), kind)

    for table in groups(batches, "to"):
        of_known = pa.array(table.column("kind").to_numpy() == KNOWN)
        known, rows = table.filter(of_known), table.filter(pc.invert(of_known))
        knowing = np.repeat(joined(known, "sets", np.int64), joined(known, "counts", np.int32))
        sent = joined(rows, "keys", np.uint8).reshape(-1, KEY_BYTES)
        padded = np.zeros((len(sent), 8), dtype=np.uint8)
        padded[:, :KEY_BYTES] = sent
        sizes = pc.binary_length(rows.column("keys")).to_numpy() // KEY_BYTES
        part, kind = (np.repeat(rows.column(c).to_numpy(), sizes) for c in ("to", "kind"))
        asked = padded.view(np.uint64).ravel() | part.astype(np.uint64) << np.uint64(8 * KEY_BYTES)
        asking = np.repeat(joined(rows, "sets", np.int64), joined(rows, "counts", np.int32))
        order = np.lexsort((asking, asked))
        asked, asking, marked = asked[order], asking[order], (kind == SHARED)[order]
        fresh = np.append(True, asked[1:] != asked[:-1])[: len(asked)]
        group = np.cumsum(fresh) - 1
        other = np.append(False, (asking[1:] != asking[:-1]) & ~fresh[1:])[: len(asked)]
        found = (np.bincount(group, marked | other) > 0)[group] if len(group) else fresh
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([asked[found], joined(known, "keys", np.uint64)]).view(np.int64)),
                pa.array(np.concatenate([asking[found], knowing])),
            ],
            ["key", "set"],
        )


def packed_sets(words: int):
    """(set, packed text), each set once a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text"):
            sets = Sets(batch.column("text"), words)
            ids, first = np.unique(sets.ids(), return_index=True)
            keep = sets.sizes[first] > 0
            texts = batch.column("text").cast(pa.binary()).take(pa.array(first[keep])).to_pylist()
            packed = pa.array([squeeze(x) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), packed], ["set", "packed"])

    return run


def linked_sets(values: np.ndarray, first: np.ndarray, sides: np.ndarray, cross: bool, percent: int):
    """Yields (i, positions of the sets linked with set i), by one traversal of their trie."""
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    unique, inverse, spread = np.unique(values, return_inverse=True, return_counts=True)
    order = np.lexsort((unique, -spread))
    rank = np.empty(len(unique), dtype=np.int64)
    rank[order] = np.arange(len(unique))
    ranks = rank[inverse]
    by_token = np.lexsort((owner, ranks))
    holders, token_first = owner[by_token], np.concatenate([[0], np.cumsum(spread[order])])
    shared = int(np.count_nonzero(spread > 1))  # later ranks are in one set only
    paths = []
    for low, high in zip(first[:-1], first[1:]):
        path = np.sort(ranks[low:high])
        paths.append(path[path < shared])
    walk = sorted(range(len(sizes)), key=lambda i: paths[i].astype(">u4").tobytes())

    def common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    lcp = [common(paths[a], paths[b]) for a, b in zip(walk[:-1], walk[1:])] + [0]
    stack = [(0, np.zeros(len(sizes), dtype=np.int64))]
    for step, i in enumerate(walk):
        path, size, branch = paths[i], sizes[i], lcp[step]
        need = -(-percent * (size + sizes) // (100 + percent))
        fits = (100 * np.minimum(size, sizes) >= percent * np.maximum(size, sizes)) & (np.arange(len(sizes)) != i)
        if cross:
            fits &= sides != sides[i]
        depth, overlap = stack[-1]
        for stop in sorted({branch, (len(path) + 1) // 2, len(path)}):
            if stop <= depth:
                continue
            alive = fits & (overlap + (len(path) - depth) >= need)
            if not alive.any() and depth >= branch:
                fits = alive
                break
            spans = [holders[token_first[t] : token_first[t + 1]] for t in path[depth:stop]]
            overlap = overlap + np.bincount(np.concatenate(spans), minlength=len(sizes))
            depth = stop
            if depth == branch and depth > stack[-1][0]:
                stack.append((depth, overlap))
        yield i, np.flatnonzero(fits & (overlap >= need))
        while stack[-1][0] > branch:
            stack.pop()


def join_units(words: int, percent: int):
    """Per task: (node, low, links), low being the least set it is linked with over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for table in groups(batches, "task", 4 << 20):
            task = table.column("task").to_numpy()
            edges = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            ids, copies, block = (table.column(c).to_numpy() for c in ("set", "copies", "block"))
            cross = table.column("cross").to_numpy()
            packed = table.column("packed")
            nodes, lows, links = [], [], []
            for low, high in zip(edges, np.append(edges[1:], len(task))):
                own, at = np.unique(ids[low:high], return_index=True)
                at += low
                texts = pa.array([expand(packed[int(k)].as_py()) for k in at], pa.large_binary())
                sets = Sets(texts, words)
                weight, label = copies[at], np.arange(len(own))
                found = np.zeros(len(own), dtype=np.int64)
                for i, others in linked_sets(sets.values, sets.first, block[at], bool(cross[low]), percent):
                    if len(others):
                        found[i] = weight[others].sum()
                        meet = np.unique(np.append(label[others], label[i]))
                        if len(meet) > 1:
                            label[np.isin(label, meet)] = meet[0]
                linked = np.flatnonzero(found)
                nodes.append(own[linked])
                lows.append(own[label[linked]])
                links.append(found[linked])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (nodes, lows, links)], ["node", "low", "links"]
            )

    return run


def sieve(percent: int):
    """Edges (node, low) among the sets of a task whose outlines allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "task", 4 << 20):
            task = table.column("task").to_numpy()
            edges = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            ids, sizes, block = (table.column(c).to_numpy() for c in ("set", "n", "block"))
            cross, outlines = table.column("cross").to_numpy(), table.column("outline").to_pylist()
            nodes, lows = [], []
            for low, high in zip(edges, np.append(edges[1:], len(task))):
                order = low + np.argsort(sizes[low:high], kind="stable")
                own, size, side = ids[order], sizes[order], block[order]
                rows = [outline_counts(outlines[k]) for k in order]
                label = alike_outlines(size, rows, side if cross[low] else None, percent)
                least = np.full(len(own), np.iinfo(np.int64).max)
                np.minimum.at(least, label, own)
                moved = least[label] != own
                nodes.append(own[moved])
                lows.append(least[label][moved])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(lows))], ["node", "low"]
            )

    return run


def alike_outlines(sizes: np.ndarray, rows: list[np.ndarray], sides: np.ndarray | None, percent: int) -> np.ndarray:
    """Labels of the components of sets, by ascending size, that may be linked."""
    label = np.arange(len(sizes))
    bits = outline_bits(sizes)
    starts = np.flatnonzero(np.append(True, bits[1:] != bits[:-1])) if len(bits) else bits
    stops = np.append(starts[1:], len(bits))
    for at, (start, stop) in enumerate(zip(starts, stops)):
        # Sets of this outline width, and those one wider folded to it: larger is too large.
        top = stops[at + 1] if at + 1 < len(starts) and bits[stop] == bits[start] + 1 else stop
        # Folded counts are clipped again: both sides of a comparison have one limit.
        wide = [r if k < stop else np.minimum(r.reshape(-1, 2).sum(axis=1), MOST_COUNTED) for k, r in enumerate(rows[start:top], start)]
        table = np.stack(wide)
        for i in range(start, stop):
            last = start + int(np.searchsorted(sizes[start:top], sizes[i] * 100 // percent, side="right"))
            # Sets already connected are not compared: a group of near copies takes few rounds.
            apart = label[i + 1 : last] != label[i]
            if sides is not None:
                apart &= sides[i + 1 : last] != sides[i]
            others = i + 1 + np.flatnonzero(apart)
            if not len(others):
                continue
            rows_of_others = table[i + 1 - start : last - start] if apart.all() else table[others - start]
            differing = np.abs(rows_of_others - table[i - start]).sum(axis=1)
            near = differing <= most_differing(sizes[i] + sizes[others], percent)
            meet = np.unique(np.append(label[others][near], label[i]))
            if len(meet) > 1:
                label[np.isin(label, meet)] = meet[0]
    return label


def in_blocks(df: DataFrame, key: str, unit_tokens: int) -> DataFrame:
    """Deal the sets of each key to tasks: one, or one for every pair of blocks of sets."""
    sizes = df.groupBy(key).agg(F.ceil(F.sum("n") / unit_tokens).alias("blocks"))
    dealt = df.join(sizes, key).withColumn("block", F.expr("pmod(xxhash64(set), blocks)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    # A block pair is one task, so a block meets itself in the pair of equal blocks only.
    task = F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))
    return dealt.withColumn("cross", F.col("block") != F.col("other")).withColumn("task", task).drop("other", "blocks")


def join_tasks(signed: DataFrame, sets: DataFrame, shared: DataFrame, unit_tokens: int, percent: int) -> DataFrame:
    """(set, copies, block, cross, task): which sets meet in which task.

    The sets of each part, parts with the same sets being one, are sieved by their
    outlines; what is left is connected, and a unit is one component.
    """
    hashed = [F.bit_xor(F.xxhash64("set", F.lit(seed))).alias(f"hash{seed}") for seed in (1, 2)]
    alike = shared.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *hashed)
    kept = alike.groupBy("m", "hash1", "hash2").agg(F.min("key").alias("key")).select("key")
    outlines = signed.join(shared.select("set").distinct(), "set", "left_semi")
    outlines = outlines.groupBy("set").agg(F.first("outline").alias("outline"))
    # Sizes are dealt first: an outline travels once, to its task.
    parts = shared.join(kept, "key").join(sets.select("set", "n"), "set")
    dealt = in_blocks(parts, "key", unit_tokens).select("task", "set", "n", "block", "cross").join(outlines, "set")
    edges = (
        dealt.repartition(partitions(shared.sparkSession), "task").sortWithinPartitions("task")
        .mapInArrow(sieve(percent), "node long, low long")
    )
    units = components(edges).select(F.col("node").alias("set"), F.col("component").alias("unit"))
    members = sets.select("set", "copies", "n").join(units, "set")
    return in_blocks(members, "unit", unit_tokens).select("set", "copies", "block", "cross", "task")


def near_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    unit_tokens: int = UNIT_TOKENS,
) -> DataFrame:
    """Per row: `id`, `n_shingles`, `component_id` (least id of its component) and `n_links`.

    Texts link when 100 * intersection >= percent * union of their shingle sets; A-Z count
    as a-z.  Fewer than `words` words are one shingle; no words, or a null text, are an
    empty set, linked with nothing.  Rows without id link like others but name no
    component; rows repeated in full are copies of one another.  `n_links` counts the
    other rows a row is linked with.  Sets go by a 64-bit hash.
    """
    if not 50 <= percent < 100:
        raise ValueError("A similarity is 50 to 99 percent.")
    spark = ready(docs.sparkSession)
    source = renamed(docs, id=id_column, text=text_column).withColumn("text", text_of("text"))
    texts = source.select("text")
    signed = T.StructType([source.schema["id"]]).add("set", "long").add("n", "long").add("outline", "binary")
    signed = written(source.mapInArrow(signature_rows(words), signed), "sets")
    sets = signed.where("n > 0").groupBy("set").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("low_id"), F.max("n").alias("n")
    )
    ranges = max(LEAST_RANGES, partitions(spark))
    rows = texts.mapInArrow(candidate_rows(words, percent, ranges), CANDIDATES).repartitionById(ranges, "to")
    shared = rows.sortWithinPartitions("to").mapInArrow(shared_keys, "key long, set long")
    shared = written(shared.distinct(), "shared")
    tasks = written(join_tasks(signed, sets, shared, unit_tokens, percent), "tasks")
    packed = texts.mapInArrow(packed_sets(words), "set long, packed binary")
    linked = (
        packed.join(tasks, "set").repartition(partitions(spark), "task").sortWithinPartitions("task")
        .mapInArrow(join_units(words, percent), "node long, low long, links long")
    )
    linked = written(linked, "links")
    names = components(linked.select("node", "low"))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        sets.join(counts, F.col("set") == F.col("node"), "left").drop("node")
        .join(names, F.col("set") == F.col("node"), "left")
        .select("set", "copies", "low_id", F.coalesce("links", F.lit(0)).alias("links"),
                F.coalesce("component", "set").alias("component"))
    )
    least = known.groupBy("component").agg(F.min("low_id").alias("component_id"))
    known = known.join(least, "component").select(
        "set", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links")
    )
    return signed.join(known, "set", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row of each component of near copies, with all columns: that of the least id.

    Rows without id come after all others, ties go by a hash of the text, and of rows
    equal in id and text one stays.
    """
    ready(docs.sparkSession)
    named, name = with_row_name(docs, id_column, text_column)
    found = near_copies(named, name, text_column, **options).where(F.col("id").eqNullSafe(F.col("component_id")))
    kept, kept_row, kept_check = with_row_keys(found.select(F.col("id").alias("kept")).distinct(), "kept")
    named, row, check = with_row_keys(named, name)
    chosen = named.join(kept, same_row(row, check, kept_row, kept_check), "left_semi")
    return chosen.dropDuplicates([row, check]).drop(row, check)
