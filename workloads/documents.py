"""Flattening documents built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import DataError, Documents, FlattenDocument
from millrace.session import scratch_path
from millrace.sinks.datasets import DatasetStore, Lifecycle

from .registry import query

# Turns per document, so that a conversation of any length is many documents.
TURNS = 100


def conversation_documents(load):
    """`{"conv": {...}, "turns": [...], "marks": [...]}` per stretch of a conversation.

    A stretch has at most `TURNS` rows, as (conv_id, turn) is a key.
    """
    part = F.floor(F.col("turn") / TURNS).alias("part")
    turn = F.struct("turn", "role", "text")
    grouped = (
        load("conversations")
        .groupBy("conv_id", part)
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    )
    conv = F.struct(
        F.struct(F.col("conv_id").alias("id"), "part").alias("conv"),
        F.transform("turns", lambda t: F.struct(t["turn"], t["role"], t["text"])).alias("turns"),
        F.array(F.lit("a"), F.lit("b")).alias("marks"),
    )
    return Documents.of(
        grouped.select("conv_id", "part", F.to_json(conv).alias("body")), "body", ["conv_id", "part"]
    )


def event_documents(load):
    """`{"event": {"id", "user": {...}}, "tags": [...], "props": {...}}` per event."""
    body = F.to_json(
        F.struct(
            F.struct(
                F.col("event_id").alias("id"),
                F.struct("user_id", "value").alias("user"),
            ).alias("event"),
            F.array("event_type", F.lit("é")).alias("tags"),
            F.from_json("props", "k bigint").alias("props"),
        )
    )
    return Documents.of(load("events").select("event_id", body.alias("body")), "body", ["event_id"])


@query(
    "doc_flatten_json",
    """SELECT conv_id AS "conv.id", turn // 100 AS "conv.part",
       '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS turns,
       max(n) AS n
       FROM (SELECT *, 1.5::DOUBLE AS n FROM conversations) GROUP BY conv_id, turn // 100""",
)
def doc_flatten_json(load, spark):
    part = F.floor(F.col("turn") / TURNS).alias("part")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role")))
    grouped = load("conversations").groupBy("conv_id", part).agg(turns.alias("turns"))
    body = F.to_json(
        F.struct(
            F.struct(F.col("conv_id").alias("id"), "part").alias("conv"), "turns", F.lit(1.5).alias("n")
        )
    )
    docs = Documents.of(grouped.select("conv_id", "part", body.alias("body")), "body", ["conv_id", "part"])
    return FlattenDocument()(docs).frame()


@query(
    "doc_flatten_explode",
    """SELECT conv_id AS "conv.id", turn // 100 AS "conv.part", turn AS "turns.turn", role AS "turns.role",
       text AS "turns.text", mark AS marks FROM conversations, (VALUES ('a'), ('b')) AS m(mark)""",
)
def doc_flatten_explode(load, spark):
    return FlattenDocument(array_mode="explode")(conversation_documents(load)).frame()


@query("doc_record_path", "SELECT turn, role, text FROM conversations")
def doc_record_path(load, spark):
    return FlattenDocument(["turns"])(conversation_documents(load)).frame()


@query(
    "doc_separator",
    """SELECT event_id AS event__id, user_id AS event__user__user_id, value AS event__user__value,
       '["' || event_type || '","é"]' AS tags, CAST(props->>'k' AS BIGINT) AS props__k FROM events""",
)
def doc_separator(load, spark):
    return FlattenDocument(separator="__")(event_documents(load)).frame()


@query(
    "doc_irregular",
    """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_type END AS tag,
       CASE WHEN event_id % 3 = 1 THEN value END AS "tag.value"
       FROM events WHERE event_id % 3 < 2
       UNION ALL
       SELECT event_id, t, NULL FROM events, (VALUES ('x'), ('y')) AS v(t) WHERE event_id % 3 = 2""",
)
def doc_irregular(load, spark):
    """One path holds a text, an object or an array, by record."""
    kind = F.col("event_id") % 3
    body = (
        F.when(kind == 0, F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("tag"))))
        .when(kind == 1, F.to_json(F.struct(F.col("event_id").alias("id"), F.struct("value").alias("tag"))))
        .otherwise(
            F.to_json(
                F.struct(F.col("event_id").alias("id"), F.array(F.lit("x"), F.lit("y")).alias("tag"))
            )
        )
    )
    docs = Documents.of(load("events").select("event_id", body.alias("body")), "body", ["event_id"])
    return FlattenDocument(array_mode="explode")(docs).frame()


@query(
    "doc_empty_arrays",
    """SELECT l_orderkey AS key, l_partkey AS part, l_returnflag AS flags FROM lineitem
       WHERE l_linenumber % 2 = 1
       UNION ALL SELECT l_orderkey, l_partkey, NULL FROM lineitem WHERE l_linenumber % 4 = 0""",
)
def doc_empty_arrays(load, spark):
    """An empty array drops its record; a null one does not."""
    flags = (
        F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit('["'), F.col("l_returnflag"), F.lit('"]')))
        .when(F.col("l_linenumber") % 4 == 0, F.lit("null"))
        .otherwise(F.lit("[]"))
    )
    body = F.format_string('{"key":%d,"part":%d,"flags":%s}', "l_orderkey", "l_partkey", flags)
    docs = Documents.of(load("lineitem").select(body.alias("body")), "body")
    return FlattenDocument(array_mode="explode")(docs).frame()


# One defect per kind of rejected document, as a body built from each event.
DEFECTS = {
    "collision": """'{"a.b":' || event_id || ',"a":{"b":1}}'""",
    "empty key": """'{"":' || event_id || '}'""",
    "nested array": """'{"a":[[' || event_id || ']]}'""",
    "record is no object": """'[' || event_id || ']'""",
    "mixed types": """'{"a":' || IF(event_id % 2 = 0, '1', '"x"') || '}'""",
    "not JSON": """'{"a":' || event_id""",
    "sound": """'{"a":' || event_id || '}'""",
}


@query(
    "doc_rejects",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{d}', {str(d != 'sound').lower()})" for d in DEFECTS)
    + ") AS v(defect, rejected)",
)
def doc_rejects(load, spark):
    """Which documents, built from all events, flatten refuses."""
    rows = []
    for defect, body in DEFECTS.items():
        docs = Documents.of(load("events").selectExpr(f"{body} AS body"), "body")
        try:
            FlattenDocument(array_mode="explode").discover(docs)
            rows.append((defect, False))
        except DataError:
            rows.append((defect, True))
    return spark.createDataFrame(rows, "defect string, rejected boolean")


# -- documents no parser limit may touch ---------------------------------------------

LONG = 21_000_000
ODD_SQL = f"""SELECT lang, any_value(source) AS _corrupt_record, {LONG}::BIGINT AS size,
  sha256(rpad(max(text), {LONG}, max(text))) AS digest, 3::BIGINT AS records
  FROM (SELECT lang, text, 'x' AS source FROM documents) GROUP BY lang"""


def long_documents(load):
    """Per language a document with a text of 21 million characters made of its texts, a
    number of 1,200 digits in one of its records, and a key the reader once took for its own."""
    texts = load("documents").groupBy("lang").agg(F.max("text").alias("text"))
    head = F.to_json(
        F.struct("lang", F.lit("x").alias("_corrupt_record"), F.rpad("text", LONG, F.col("text")).alias("text"))
    )
    number = F.lit("0." + "1" * 1200)
    records = F.concat(F.lit('"records":[{"n":1.5},{"n":'), number, F.lit('},{"n":2.5}]'))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), records, F.lit("}"))
    return Documents.of(texts.select("lang", body.alias("body")), "body", ["lang"])


def summarised(table):
    return (
        table.frame().groupBy("lang", "_corrupt_record")
        .agg(F.max(F.length("text")).cast("bigint").alias("size"), F.max(F.sha2("text", 256)).alias("digest"),
             F.count("`records.n`").alias("records"))
    )


@query("doc_long_values", ODD_SQL)
def doc_long_values(load, spark):
    return summarised(FlattenDocument([], "explode")(long_documents(load)))


@query("snk_long_documents", ODD_SQL)
def snk_long_documents(load, spark):
    store = DatasetStore(spark, scratch_path(spark, "store"))
    kept = store.persist_documents(long_documents(load), Lifecycle("pipe", "run"))
    return summarised(FlattenDocument([], "explode")(store.documents(kept)))
