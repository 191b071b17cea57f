"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import fingerprints, language_id, line_dedup, lm_score, mixing, negatives, ngram_join, packing, runs
from . import substring_dedup, suffix_dedup, topk, warc
from .following import with_next_text
from .frames import ready, renamed, text_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", "text")


OP1_SQL = f"""
WITH pages AS (
  SELECT doc_id, text, coalesce('=' || source, '') AS host, string_split(text, chr(10)) AS lines FROM documents
), totals AS (
  SELECT host, count(*) AS total FROM pages GROUP BY host
), on_page AS (
  SELECT host, unnest(list_distinct(list_transform(lines, lambda x: trim(x)))) AS line FROM pages
), common AS (
  SELECT host, line FROM on_page JOIN totals USING (host) WHERE line <> ''
  GROUP BY host, line, total HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > total * {line_dedup.RATIO}::DOUBLE
), by_host AS (
  SELECT host, list(line) AS found FROM common GROUP BY host
), kept AS (
  SELECT doc_id, text, len(lines) AS n_lines,
         list_filter(lines, lambda x: NOT list_contains(coalesce(found, []), trim(x))) AS lines
  FROM pages LEFT JOIN by_host USING (host)
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines - len(lines), 0)::BIGINT AS n_dropped,
       array_to_string(lines, chr(10)) AS text
FROM kept
"""


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


OP2_SQL = f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT row, doc_id, array_to_string(w[i:i + {ngram_join.WORDS - 1}], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {ngram_join.WORDS - 1}, least(len(w), 1)) + 1)) AS i FROM words)
), sizes AS (
  SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM shingles GROUP BY row
), pairs AS (
  SELECT a.row AS x, b.row AS y, count(*) AS shared FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.row <> b.row GROUP BY a.row, b.row
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.row = x JOIN sizes t ON t.row = y
  WHERE 100 * shared >= {ngram_join.PERCENT} * (s.n + t.n - shared)
), reach AS (
  SELECT DISTINCT x AS row, x AS to_row FROM links
  UNION SELECT reach.row, links.y FROM reach JOIN links ON links.x = reach.to_row
), component AS (
  SELECT reach.row, min(sizes.doc_id) AS component_id FROM reach JOIN sizes ON sizes.row = to_row GROUP BY reach.row
), degree AS (
  SELECT x AS row, count(*) AS n_links FROM links GROUP BY x
)
SELECT words.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
       CASE WHEN component.row IS NULL THEN words.doc_id ELSE component_id END AS component_id,
       coalesce(n_links, 0)::BIGINT AS n_links
FROM words LEFT JOIN sizes USING (row) LEFT JOIN component USING (row) LEFT JOIN degree USING (row)
"""


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeated(table(spark, folder, "documents"))
    return kept.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


OP5_SQL = f"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT row, i, array_to_string(w[i:i + {substring_dedup.WIDTH - 1}], ' ') AS span
  FROM (SELECT *, unnest(range(1, len(w) - {substring_dedup.WIDTH - 1} + 1)) AS i FROM words)
), again AS (
  SELECT row, i FROM windows JOIN (SELECT span FROM windows GROUP BY span HAVING count(*) > 1) USING (span)
), gone AS (
  SELECT DISTINCT row, unnest(range(i, i + {substring_dedup.WIDTH})) AS i FROM again
), removed AS (
  SELECT row, list(i) AS places FROM gone GROUP BY row
), kept AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed, CASE WHEN places IS NULL THEN w
         ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END AS rest
  FROM words LEFT JOIN removed USING (row)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(rest, ' '), '')) AS kept_sha256 FROM kept
"""


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lm_score.score(docs, lm_score.trained(docs)).withColumnRenamed("id", "doc_id")


def held_out() -> Column:
    """Documents no model may learn from; without id a document is in neither part."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.Model.learn(docs.where(~held_out()))
    found = language_id.predict(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), packing.production_vocabulary())
    return pieces.drop("ids").withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(ready(spark), "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    responses = warc.read_archives(spark, path).where("record_type = 'response'")
    headers = [c for c in warc.HEADERS if c != "content_length"]
    revisits = warc.read_archives(spark, path, headers).where("record_type = 'revisit'")
    responses = responses.select(
        number("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = revisits.select(
        number("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.replace("payload_digest", F.lit("sha1:"), F.lit("")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)


OP7_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS hex FROM pages
), groups AS (
  SELECT page_id, size, hex, min(page_id) OVER (PARTITION BY hex) AS first,
         list_transform(range(8), lambda g: ('0x' || substr(hex, (5 * g + 1)::INT, 5))::INT) AS bits
  FROM hashed
)
SELECT page_id, size::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((bits[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM groups
"""


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = renamed(table(spark, folder, "documents"), id="doc_id", text="text")
    docs = with_next_text(docs.withColumn("text", text_of("text")), "next")
    size, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - third), F.substring("next", F.lit(1), third))
    docs = docs.withColumn("edited", edited)
    for text in ("text", "edited", "next"):
        docs = fingerprints.with_sketch(docs, text, f"{text}_sketch")
    own, edited, next_ = (F.col(f"{text}_sketch") for text in ("text", "edited", "next"))
    return docs.select(
        F.col("id").alias("doc_id"),
        size.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.resemblance(own, edited).alias("near_edited"),
        fingerprints.resemblance(own, next_).alias("near_next"),
    )


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP10_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP11_SQL = f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS (
  SELECT row, i, md5(array_slice(b, i + 1, i + {suffix_dedup.WIDTH})) AS string
  FROM (SELECT *, unnest(range(0, octet_length(b) - {suffix_dedup.WIDTH} + 1)) AS i FROM texts)
), again AS (
  SELECT row, i, lag(i) OVER (PARTITION BY row ORDER BY i) AS before
  FROM starts JOIN (SELECT string FROM starts GROUP BY string HAVING count(*) > 1) USING (string)
), numbered AS (
  SELECT row, i, count(*) FILTER (before IS NULL OR i > before + {suffix_dedup.WIDTH})
         OVER (PARTITION BY row ORDER BY i) AS span FROM again
), spans AS (
  SELECT row, span, min(i) AS start, max(i) + {suffix_dedup.WIDTH} AS stop FROM numbered GROUP BY row, span
), pieces AS (
  SELECT row, coalesce(lag(stop) OVER (PARTITION BY row ORDER BY start), 0) AS low, start, stop FROM spans
), kept AS (
  SELECT row, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS rest,
         string_agg(hex(array_slice(b, low + 1, start)), '' ORDER BY start) AS head
  FROM pieces JOIN texts USING (row) GROUP BY row
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || hex(array_slice(b, coalesce(rest, 0) + 1, octet_length(b))))) AS kept_sha256
FROM texts LEFT JOIN kept USING (row)
"""


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS kin, list_inner_product(a.vec, c.vec)::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE kin
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT
         AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT kin AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT * FROM ranked WHERE rank <= 3
"""


def cycled(text: Column, key: Column) -> Column:
    """Texts of a tenth of the documents end in a cycle: words from `a` on repeat with period `p`."""
    group = F.floor(key / 10)
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    changed = key % 10 == 0

    def cycle(w: Column) -> Column:
        n = F.size(w)
        a = (group % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + group % 8))).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.array_join(F.concat(F.slice(w, 1, a), tail), " ")

    # The words are bound once, as the element of a one-element array.
    bound = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, cycle(w)).otherwise("")), 0)
    return F.when(changed & text.isNotNull(), bound).otherwise(text)


def strongest(found: Column) -> Column:
    """Of runs the one of the greatest length by period; ties: smallest start, then period."""

    def before(a: Column, b: Column) -> Column:
        one, other = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(one != other, F.when(one > other, -1).otherwise(1))
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
        )

    return F.get(F.array_sort(found, before), 0)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", cycled(F.col("text"), F.crc32(F.col("doc_id").cast("string"))))
    found = runs.collapse_runs(docs).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op10_topk": op10_topk,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
    "op2_ngram_join": op2_ngram_join,
    "op3_lm_score": op3_lm_score,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_fingerprints": op8_fingerprints,
    "op9_mixing": op9_mixing,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_ngram_join": OP2_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op10_topk": OP10_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op7_warc": OP7_SQL,
}
