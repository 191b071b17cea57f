"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are read as lower-case letters with single blanks between runs of them; their n-grams
of one to three characters are hashed to `BUCKETS`.  Learning counts buckets per language
over every labelled text: tasks add up their counts, Spark sums them, and a task per
language makes its row of log-probabilities.  Scoring gathers them per n-gram and sums them
per text in numpy, `AT_ONCE` languages at a time.  So many or fewer, a matrix of 16 MB at
most, are broadcast; more stay in the shared folder, a file for every `AT_ONCE`, which tasks
read one after the other with equal results.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, small_frame
from ..table import col
from .frames import ready, renamed, text_of, written
from .text import slices

BUCKETS = 1 << 16
SMOOTHING = 0.5
AT_ONCE = 64
UNKNOWN = "und"
SLICE = 1 << 18

_folded: np.ndarray | None = None


def folding() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    global _folded
    if _folded is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if unicodedata.category(char)[0] == "L":
                lower = char.lower()
                table[code] = ord(lower) if len(lower) == 1 else code
        _folded = table
    return _folded


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all n-grams, where each text's begin and end, and whether it has letters."""
    plain = [t or "" for t in texts.to_pylist()]
    # One blank before and two after each text: no n-gram of a text reaches into the next.
    codes = np.frombuffer("".join([f"\n{t}\n\n" for t in plain]).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in plain], dtype=np.int64)
    stops = np.cumsum(lengths + 3) - 2
    starts = stops - lengths - 1
    letters = folding()[codes]
    # Blanks after a blank go.
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0)
    keep[starts], keep[stops], keep[stops + 1] = True, True, True
    places = np.concatenate([[0], np.cumsum(keep)])
    some = np.concatenate([[0], np.cumsum(letters != 0)])
    row = letters[keep].astype(np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    one = (row + np.uint64(1)) * factor
    two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + one[2:]
    grams = np.zeros((len(row), 3), dtype=np.int32)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    for n, values in enumerate((one, two, three)):
        values = values * np.uint64(0xD6E8FEB86659FD93)
        grams[: len(values), n] = (values >> shift).astype(np.int32)
    return grams, places[starts], places[stops], some[stops] > some[starts]


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) over what one task reads; bucket -1 counts texts.

    A task holds the counts of `AT_ONCE` languages and passes them on when there are more.
    """
    totals: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}

    def held() -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(at) + 1)),
                    pa.array(np.append(at, -1).astype(np.int32)),
                    pa.array(np.append(total[at], texts[lang])),
                ],
                ["lang", "bucket", "n"],
            )
        totals.clear()
        texts.clear()

    for batch in slices(batches, "text", SLICE):
        grams, starts, stops, lettered = buckets(batch.column("text"))
        rows: dict[str, list[int]] = {}
        for row, lang in enumerate(batch.column("lang").to_pylist()):
            if lettered[row]:
                rows.setdefault(lang, []).append(row)
        for lang, own in rows.items():
            if lang not in totals and len(totals) == AT_ONCE:
                yield from held()
            inside = np.concatenate([np.arange(starts[row], stops[row]) for row in own])
            total = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            total += np.bincount(grams[inside].ravel(), minlength=BUCKETS)
            texts[lang] = texts.get(lang, 0) + len(own)
    yield from held()


LANGUAGE = "lang string, texts long, typical double, weights binary"


def language_row(counts: pa.Table) -> pa.Table:
    """The log-probabilities of one language from its counts."""
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    seen = np.zeros(BUCKETS)
    seen[bucket[bucket >= 0]] = n[bucket >= 0]
    weights = np.log(seen + SMOOTHING) - np.log(seen.sum() + SMOOTHING * BUCKETS)
    typical = (seen * weights).sum() / max(seen.sum(), 1)
    return pa.table(
        {
            "lang": [counts.column("lang")[0].as_py()],
            "texts": pa.array([int(n[bucket < 0].sum())], pa.int64()),
            "typical": pa.array([typical], pa.float64()),
            "weights": [weights.astype(np.float32).tobytes()],
        }
    )


def matrix(rows: pa.ChunkedArray) -> np.ndarray:
    """Buckets x languages from the rows of languages."""
    blobs = [np.frombuffer(blob, np.float32) for blob in rows.to_pylist()]
    return np.stack(blobs, axis=1) if blobs else np.zeros((BUCKETS, 0), np.float32)


@dataclass(frozen=True)
class Model:
    """Languages in code point order, log-priors, and for each language the mean
    log-probability of its own n-grams; log-probabilities by bucket, or the folder of them."""

    languages: list[str]
    priors: np.ndarray
    typical: np.ndarray
    weights: np.ndarray | None
    folder: str | None = None

    @classmethod
    def learn(cls, labelled: DataFrame, text_column: str = "text", lang_column: str = "lang") -> "Model":
        """From every row with a language; texts without letters teach nothing."""
        spark = ready(labelled.sparkSession)
        rows = renamed(labelled, text=text_column, lang=lang_column).where("lang IS NOT NULL")
        counts = rows.select(text_of("text").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(
            count_rows, "lang string, bucket int, n long"
        )
        summed = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        made = written(summed.groupBy("lang").applyInArrow(language_row, LANGUAGE), "languages")
        known = made.select("lang", "texts", "typical").orderBy("lang").collect()  # a name and two numbers each
        languages = [r["lang"] for r in known]
        texts = np.array([r["texts"] for r in known], dtype=np.float64)
        figures = (languages, np.log(texts / max(texts.sum(), 1)), np.array([r["typical"] for r in known]))
        if len(languages) <= AT_ONCE:
            return cls(*figures, matrix(made.select("lang", "weights").orderBy("lang").toArrow().column("weights")))
        places = small_frame(spark, [(name, at) for at, name in enumerate(languages)], "lang string, place int")
        placed = made.join(places, "lang").select("place", "weights", F.floor(F.col("place") / AT_ONCE).alias("block"))
        folder = scratch_path(spark, "weights")
        placed.repartition("block").write.partitionBy("block").parquet(folder)
        return cls(*figures, None, folder)

    def parts(self) -> Iterator[np.ndarray]:
        """The log-probabilities of the languages in turn, so many at a time."""
        if self.weights is not None:
            yield self.weights
            return
        files, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", self.folder))
        for block in range(-(-len(self.languages) // AT_ONCE)):
            rows = pq.read_table(f"{root}/block={block}", columns=["place", "weights"], filesystem=files, partitioning=None)
            yield matrix(rows.sort_by("place").column("weights"))

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the index of its language, or -1, and the posterior probability."""
        return self.fits(texts)[:2]

    def fits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `scores`, and how well each text fits its language, whatever the others are.

        That is its mean log-probability per n-gram, on a scale where 0 is the n-gram of
        evenly used buckets and 1 the mean of the language's own labelled texts.
        """
        grams, starts, stops, lettered = buckets(texts)
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
        count, start = len(starts), 0
        best, top, total, plain = np.full(count, -1), np.full(count, -np.inf), np.zeros(count), np.zeros(count)
        edges = np.stack([starts, stops], axis=1).ravel()
        for weights in self.parts():
            each = weights[grams[:, 0]] + weights[grams[:, 1]]
            each += weights[grams[:, 2]]
            own = np.add.reduceat(each, edges, axis=0, dtype=np.float64)[::2]
            sums = own + self.priors[start : start + weights.shape[1]]
            at = sums.argmax(axis=1)
            value = sums[np.arange(count), at]
            # Probabilities are summed in units of the likeliest language so far.
            likelier, before = value > top, top
            top = np.maximum(top, value)
            total = total * np.exp(before - top) + np.exp(sums - top[:, None]).sum(axis=1)
            best = np.where(likelier, start + at, best)
            plain = np.where(likelier, own[np.arange(count), at], plain)
            start += weights.shape[1]
        mean = plain / (3 * (stops - starts))
        even = -np.log(BUCKETS)
        fit = (mean - even) / np.maximum(self.typical[best] - even, 1e-9)
        return np.where(lettered, best, -1), np.where(lettered, 1.0 / total, 0.0), np.where(lettered, fit, 0.0)


def predict_rows(shared, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in slices(batches, "text", SLICE):
            best, *figures = model.fits(batch.column("text"))
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names[best], pa.string()), *map(pa.array, figures[: len(added) - 1])],
                [*[n for n in batch.schema.names if n != "text"], *added],
            )

    return run


def annotate(docs: DataFrame, model: Model, text_column: str = "text", fit: bool = False) -> DataFrame:
    """All rows and columns of `docs` with `lang_pred`, `score` and, if asked for, `fit`
    (they replace such columns)."""
    spark = ready(docs.sparkSession)
    added = ["lang_pred", "score", *["fit"][:fit]]
    kept = [c for c in docs.columns if c not in added]
    carried = {f"column{i}": c for i, c in enumerate(kept)}
    source = docs.select(
        *[col(c).alias(name) for name, c in carried.items()], text_of(text_column).alias("text")
    )
    schema = T.StructType([T.StructField(name, docs.schema[c].dataType) for name, c in carried.items()])
    for name in added:
        schema = schema.add(name, "string" if name == "lang_pred" else "double")
    found = source.mapInArrow(predict_rows(spark.sparkContext.broadcast(model), added), schema)
    return found.toDF(*kept, *added)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: `id`, `lang_pred` and `score`, the probability of that language, 0 to 1.

    Null texts and texts without a letter, and all texts if no language was learned, are
    `und` with score 0.  Ties go to the first language in code point order.  Ids may be
    null or repeated.
    """
    return annotate(renamed(docs, id=id_column, text=text_column), model).drop("text")
