"""Masked pseudo-likelihood of texts under a bidirectional window network.

Every word is predicted from the `SIDE` words on either side of it, the word itself being
masked.  A word is a hash bucket; buckets are grouped in `CLASSES` of about equal weight by
their counts in the whole corpus.  The network - one embedding per position and class, a
tanh layer, a softmax - gives the probability of the class, the counts that of the
bucket within it.  A text's score is the sum of the logarithms over its words.

This is an approximation: context decides between classes only.  Words of one class can
change places without a change of the score, so rare words in disorder may score like a
text; and words that share a bucket share its probability.

Counts cover every word of the corpus: each task sends its buckets once.  The network is
trained in numpy by rounds of local stochastic descent: each task walks through its
texts and sends its weights; Spark adds them up in fixed point, so a repeated task changes
nothing.  The rounds share the words of every text in turn, so each word is a target in
exactly one of them.  Tables and weights
that reach the driver have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import ready, renamed, text_of
from .text import Words, slices

BUCKETS = 1 << 18
CLASSES = 128
WIDTH = 32
SIDE = 2
ROUNDS = 3
BATCH = 1024
RATE = 0.2
SMOOTHING = 0.1
FIXED = float(1 << 24)
SLICE = 1 << 20


def word_buckets(words: Words) -> np.ndarray:
    return (words.hashes() >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in slices(batches, "text", SLICE):
        words = Words.of(batch.column("text"))
        if len(words):
            total += np.bincount(word_buckets(words), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


@dataclass(frozen=True)
class Network:
    """Class and in-class log-probability per bucket; weights of the network."""

    classes: np.ndarray
    inside: np.ndarray
    embedding: np.ndarray
    hidden: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 7) -> "Network":
        """Untrained: buckets in classes of about equal weight, the bias their shares."""
        order = np.argsort(-counts, kind="stable")
        weight = counts[order] + SMOOTHING
        place = np.cumsum(weight) - weight / 2
        classes = np.empty(BUCKETS, dtype=np.int16)
        classes[order] = np.minimum(place / weight.sum() * CLASSES, CLASSES - 1).astype(np.int16)
        # A bucket heavier than a class leaves numbers unused; the softmax learns that.
        totals = np.bincount(classes, weights=counts + SMOOTHING, minlength=CLASSES)
        inside = np.log((counts + SMOOTHING) / totals[classes])
        draw = np.random.default_rng(seed)
        return cls(
            classes,
            inside.astype(np.float32),
            draw.normal(0, 0.1, (2 * SIDE, CLASSES + 1, WIDTH)).astype(np.float32),
            np.zeros(WIDTH, dtype=np.float32),
            draw.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32),
            np.log((totals + SMOOTHING) / (totals + SMOOTHING).sum()).astype(np.float32),
        )

    def weights(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in (self.embedding, self.hidden, self.output, self.bias)])

    def with_weights(self, flat: np.ndarray) -> "Network":
        parts, at = [], 0
        for old in (self.embedding, self.hidden, self.output, self.bias):
            parts.append(flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return replace(self, embedding=parts[0], hidden=parts[1], output=parts[2], bias=parts[3])

    def windows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word the classes around it (CLASSES outside its text), and its bucket."""
        bucket = word_buckets(words)
        own = self.classes[bucket].astype(np.int64)
        text = words.text_of_word()
        around = np.full((len(own), 2 * SIDE), CLASSES, dtype=np.int64)
        for column, step in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            to = slice(max(0, -step), len(own) - max(0, step))
            source = slice(max(0, step), len(own) - max(0, -step))
            if len(own) > abs(step):
                same = text[to] == text[source]
                around[to, column] = np.where(same, own[source], CLASSES)
        return around, bucket

    def layer(self, around: np.ndarray) -> np.ndarray:
        total = self.embedding[0][around[:, 0]] + self.hidden
        for column in range(1, 2 * SIDE):
            total += self.embedding[column][around[:, column]]
        return np.tanh(total, out=total)

    def log_probabilities(self, around: np.ndarray, bucket: np.ndarray, batch: int = 4096) -> np.ndarray:
        out = np.empty(len(bucket))
        for low in range(0, len(bucket), batch):
            own = bucket[low : low + batch]
            logits = self.layer(around[low : low + batch]) @ self.output
            logits += self.bias
            chosen = logits[np.arange(len(own)), self.classes[own]]
            top = logits.max(axis=1)
            logits -= top[:, None]
            np.exp(logits, out=logits)
            out[low : low + batch] = chosen - top - np.log(logits.sum(axis=1)) + self.inside[own]
        return out


class Descent:
    """Local training: stochastic descent with per-weight step sizes."""

    def __init__(self, network: Network):
        self.network = network.with_weights(network.weights())
        parts = (self.network.embedding, self.network.hidden, self.network.output, self.network.bias)
        self.parts, self.squares = parts, [np.full(p.shape, 1e-2, dtype=np.float32) for p in parts]
        self.steps = 0

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        net = self.network
        layer = net.layer(around)
        logits = layer @ net.output + net.bias
        logits -= logits.max(axis=1)[:, None]
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1)[:, None]
        logits[np.arange(len(target)), target] -= 1
        logits /= len(target)
        back = (logits @ net.output.T) * (1 - layer * layer)
        embedding = np.zeros_like(net.embedding)
        hot = np.zeros((len(target), CLASSES + 1), dtype=np.float32)
        for column in range(2 * SIDE):
            hot[:] = 0
            hot[np.arange(len(target)), around[:, column]] = 1
            embedding[column] = hot.T @ back
        for part, square, slope in zip(
            self.parts, self.squares, (embedding, back.sum(axis=0), layer.T @ logits, logits.sum(axis=0))
        ):
            square += slope * slope
            part -= RATE * slope / np.sqrt(square)
        self.steps += 1


def train_rows(shared, turn: int, rounds: int):
    """(at, total) over one task: its weights times its steps; at -1 counts the steps.

    Targets are the words whose place in their text leaves `turn` when divided by `rounds`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        descent = Descent(shared.value)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def drain(all_of_it: bool) -> None:
            nonlocal waiting, size
            if not waiting:
                return
            around, target = (np.concatenate(x) for x in zip(*waiting))
            stop = len(target) if all_of_it else len(target) - len(target) % BATCH
            for low in range(0, stop, BATCH):
                descent.step(around[low : min(low + BATCH, stop)], target[low : min(low + BATCH, stop)])
            waiting = [(around[stop:], target[stop:])] if stop < len(target) else []
            size = len(target) - stop

        for batch in slices(batches, "text", SLICE):
            words = Words.of(batch.column("text"))
            around, bucket = descent.network.windows(words)
            place = np.arange(len(bucket)) - np.repeat(words.first[:-1], words.counts())
            chosen = np.flatnonzero(place % rounds == turn)
            if len(chosen):
                waiting.append((around[chosen], descent.network.classes[bucket[chosen]].astype(np.int64)))
                size += len(chosen)
            if size >= BATCH:
                drain(False)
        drain(True)
        if descent.steps:
            total = np.rint(descent.network.weights().astype(np.float64) * FIXED).astype(np.int64) * descent.steps
            at = np.arange(-1, len(total), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.concatenate([[descent.steps], total]))], ["at", "total"]
            )

    return run


def trained(docs: DataFrame, text_column: str = "text", rounds: int = ROUNDS) -> Network:
    """A network for the corpus; without any word it stays as it was drawn."""
    spark = ready(docs.sparkSession)
    texts = renamed(docs, text=text_column).select(text_of("text").alias("text"))
    found = texts.mapInArrow(bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    network = Network.fresh(counts)
    for turn in range(rounds):
        rows = texts.mapInArrow(train_rows(spark.sparkContext.broadcast(network), turn, rounds), "at int, total long")
        summed = rows.groupBy("at").agg(F.sum("total").alias("total")).toArrow()
        if not summed.num_rows:
            break
        totals = np.zeros(network.weights().size + 1, dtype=np.int64)
        totals[summed.column("at").to_numpy() + 1] = summed.column("total").to_numpy()
        network = network.with_weights(totals[1:] / totals[0] / FIXED)
    return network


def score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in slices(batches, "text", SLICE):
            words = Words.of(batch.column("text"))
            around, bucket = network.windows(words)
            sums = np.concatenate([[0.0], np.cumsum(network.log_probabilities(around, bucket))])
            total = sums[words.first[1:]] - sums[words.first[:-1]]
            counts = words.counts()
            mean = np.divide(total, counts, out=np.zeros(len(counts)), where=counts > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(total), pa.array(mean, mask=counts == 0)],
                ["id", "n_words", "log_probability", "score"],
            )

    return run


def score(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: `id`, `n_words`, `log_probability` (the sum) and `score` (its mean a word).

    Texts without words, and null texts, have the sum 0 and no score.  Ids may be null or
    repeated; a text's figures depend on nothing but its words and the network.
    """
    spark = ready(docs.sparkSession)
    source = renamed(docs, id=id_column, text=text_column).withColumn("text", text_of("text"))
    schema = T.StructType([source.schema["id"]]).add("n_words", "long")
    schema = schema.add("log_probability", "double").add("score", "double")
    return source.mapInArrow(score_rows(spark.sparkContext.broadcast(network)), schema)
