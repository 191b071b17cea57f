"""A corpus from documents to packed sequences: five stages, each written and read again.

Every stage works on all rows its predecessor kept, and all but the last return the columns
of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, line_dedup, mixing, ngram_join, packing
from millrace.llm.frames import ready
from millrace.session import scratch_path

LEAST_SCORE = 0.5
#: Half way from evenly used n-grams (0) to the mean of the language's labelled texts (1).
LEAST_FIT = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found: text without letters, or without a likelier half, goes,
    and so does text whose n-grams are not those of its language, such as letter junk or
    a script no labelled text holds; the posterior alone tells only languages apart."""
    model = language_id.Model.learn(docs)
    found = language_id.annotate(docs, model, fit=True).where(
        (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & (F.col("fit") >= LEAST_FIT)
    )
    return found.select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are on too many pages of their source; a text copied
    on too many pages goes on as empty documents."""
    kept = line_dedup.drop_boilerplate(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, 0.8 alike or more."""
    return ngram_join.representatives(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; the two copies of a document are packed like two documents."""
    return packing.pack(docs, packing.production_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_boilerplate),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The stages learn models, follow links and fit sums, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
