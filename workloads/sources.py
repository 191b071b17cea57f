"""Sources: files, workbooks, page chains and tables made from the driver's tables."""

from __future__ import annotations

import io
import json
import re
import zipfile
from urllib.parse import parse_qs, urlsplit
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from millrace import FlattenDocument, Table
from millrace.session import scratch_path
from millrace.sinks.datasets import DatasetStore, Lifecycle
from millrace.sinks.files import CsvSink, JsonSink
from millrace.sources.delimited import DelimitedSource
from millrace.sources.documents import JsonSource
from millrace.sources.page_stream import page_stream
from millrace.sources.pages import PagedSource, Pages
from millrace.sources.relational import CatalogDatabase, RelationalSource
from millrace.sources.workbook import WorkbookSource

from .registry import ordered, query

# -- delimited text ----------------------------------------------------------------


@query(
    "src_csv",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_orderpriority FROM orders""",
)
def src_csv(load, spark):
    root = scratch_path(spark, "csv")
    CsvSink("orders.csv").write(Table.of(load("orders")), f"{root}/orders")
    return DelimitedSource("orders")(spark, root).frame()


@query(
    "src_csv_noheader",
    """SELECT c_custkey AS column_1, c_name AS column_2, c_nationkey::BIGINT AS column_3,
       c_acctbal AS column_4, c_mktsegment AS column_5 FROM customer""",
)
def src_csv_noheader(load, spark):
    root = scratch_path(spark, "csv")
    load("customer").write.csv(f"{root}/customer", sep=";")
    return DelimitedSource("customer", has_header=False, separator=";")(spark, root).frame()


@query("src_csv_multiline", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_csv_multiline(load, spark):
    """Whole texts with line breaks, quotes and separators."""
    root = scratch_path(spark, "csv")
    CsvSink("documents.csv").write(Table.of(load("documents")), f"{root}/documents")
    return DelimitedSource("documents")(spark, root).frame()


@query(
    "src_csv_promotion",
    """SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_quantity END AS n,
       l_returnflag = 'R' AS flag, l_linenumber || 'x' AS word, l_partkey / 4 AS part FROM lineitem""",
)
def src_csv_promotion(load, spark):
    """Nulls, flags and numbers whose type only the whole column tells."""
    df = load("lineitem").selectExpr(
        "l_orderkey",
        "IF(l_linenumber % 2 = 0, NULL, l_quantity) AS n",
        "l_returnflag = 'R' AS flag",
        "l_linenumber || 'x' AS word",
        "l_partkey / 4 AS part",
    )
    root = scratch_path(spark, "csv")
    CsvSink("lines.csv").write(Table.of(df), f"{root}/lines")
    return DelimitedSource("lines")(spark, root).frame()


@query(
    "src_csv_mixed_files",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text ELSE lang END AS _corrupt_record,
       CASE WHEN doc_id % 2 = 0 THEN ' 7' ELSE doc_id || chr(10) END AS padded, doc_id::VARCHAR AS digits
       FROM documents""",
)
def src_csv_mixed_files(load, spark):
    """Files with line breaks in fields among many without, a column of the reader's own
    name, and padded or broken digits, which are no numbers."""
    root = scratch_path(spark, "csv")
    df = load("documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 10 == 0, F.col("text")).otherwise(F.col("lang")).alias("_corrupt_record"),
        F.when(F.col("doc_id") % 2 == 0, F.lit(" 7")).otherwise(F.concat("doc_id", F.lit("\n"))).alias("padded"),
        F.col("doc_id").cast("string").alias("digits"),
    )
    for part, rows in (("even", df.where("doc_id % 2 = 0 AND doc_id % 10 <> 0")), ("rest", df.where("doc_id % 2 = 1 OR doc_id % 10 = 0"))):
        CsvSink("d.csv").write(Table.of(rows), f"{root}/d/{part}")
    table = DelimitedSource("d/*")(spark, root)
    return table.frame().withColumn("digits", F.col("digits").cast("string"))


@query(
    "snk_csv_text",
    """SELECT n_nationkey || ',' || n_name || ',' || n_regionkey || ',"' || '"' AS line FROM nation
       UNION ALL SELECT 'n_nationkey,n_name,n_regionkey,empty'""",
)
def snk_csv_text(load, spark):
    """The text of the files a CSV sink writes; an empty text is quoted."""
    path = scratch_path(spark, "csv")
    CsvSink("n.csv").write(Table.of(load("nation").withColumn("empty", F.lit("")).coalesce(1)), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# -- JSON documents ----------------------------------------------------------------


@query("src_json_docs", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def src_json_docs(load, spark):
    """Files that hold one array of row objects each."""
    df = load("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    root = scratch_path(spark, "json")
    JsonSink("orders.json", rows_per_array=2000).write(Table.of(df), f"{root}/orders")
    documents = JsonSource("orders", check=False)(spark, root)
    return FlattenDocument()(documents).frame()


@query("src_json_lines", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def src_json_lines(load, spark):
    root = scratch_path(spark, "json")
    body = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"props":'), F.col("props"), F.lit("}"))
    load("events").select(body).write.text(f"{root}/events")
    table = FlattenDocument()(JsonSource("events", layout="lines")(spark, root))
    return table.frame().select("event_id", F.col("`props.k`").alias("k"))


# -- workbooks ---------------------------------------------------------------------

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
BOOK_ROWS = 1000


def sheet_bytes(header: list[str], rows: list[list]) -> bytes:
    """A small workbook with one sheet."""

    def cell(value) -> str:
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>"

    lines = "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in [header, *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="Parts" sheetId="1" '
            'r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships><Relationship Id="rId1" Type="sheet" Target="worksheets/s.xml"/></Relationships>',
        )
        book.writestr(
            "xl/worksheets/s.xml",
            f'<worksheet xmlns="{MAIN}"><sheetData>{lines}</sheetData></worksheet>',
        )
    return out.getvalue()


def part_workbooks(frame: pd.DataFrame) -> pd.DataFrame:
    columns = ["p_partkey", "p_name", "p_size", "p_retailprice"]
    rows = frame.sort_values("p_partkey")[columns].astype(object).values.tolist()
    path = f"part-{frame['book'].iloc[0]:08d}.xlsx"
    return pd.DataFrame({"path": [path], "content": [sheet_bytes(columns, rows)]})


@query("src_workbook", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part")
def src_workbook(load, spark):
    """Many workbooks of at most 1000 rows each, made from the parts by key range."""
    parts = load("part").withColumn("book", F.floor(F.col("p_partkey") / BOOK_ROWS))
    path = scratch_path(spark, "books")
    parts.groupBy("book").applyInPandas(part_workbooks, "path string, content binary").write.parquet(path)
    return WorkbookSource("parts.xlsx", sheet_name="Parts").read(spark.read.parquet(path)).frame()


# -- page chains -------------------------------------------------------------------

HOST = "https://pages.example.org"
PAGE_ROWS, PAGES = 10, 5


class PageFiles:
    """Serves requests from files written by Spark: `endpoint=<n>/page=<n>/*.txt`.

    The first page of an endpoint is the one after the watermark it is asked for.
    """

    def __init__(self, folder: str, first: int, last: int) -> None:
        self.folder, self.first, self.last = folder, first, last

    def __call__(self, url: str, headers) -> bytes:
        parts = urlsplit(url)
        asked = parse_qs(parts.query)
        page = int(asked.get("page", [self.first])[0])
        files, root = pafs.FileSystem.from_uri(re.sub("^file:/+", "/", self.folder))
        place = f"{root}/endpoint={parts.path.strip('/')}/page={page}"
        found = files.get_file_info(pafs.FileSelector(place, allow_not_found=True))
        texts = [f.path for f in found if re.search(r"part-[^/]*\.txt$", f.path)]
        if not texts:
            return json.dumps({"rows": [], "seen": {"upto": None}, "more": {"after": None}}).encode()
        with files.open_input_stream(texts[0]) as stream:
            body = json.loads(stream.read())
        if page >= self.last:
            body["more"]["after"] = None
        return json.dumps(body).encode()


def page_files(load, spark) -> tuple[str, object]:
    """Ten rows of `pages` to a page, five pages to an endpoint."""
    path = scratch_path(spark, "api")
    endpoint = F.floor(F.col("page_id") / (PAGE_ROWS * PAGES))
    page = F.floor(F.col("page_id") / PAGE_ROWS) % PAGES
    rows = load("pages").select(endpoint.alias("endpoint"), page.alias("page"), "page_id", "url", "html")
    data = F.sort_array(F.collect_list(F.struct("page_id", "url", "html"))).alias("rows")
    grouped = rows.groupBy("endpoint", "page").agg(data, F.max("page_id").alias("upto"))
    following = F.when(F.col("page") < PAGES - 1, (F.col("page") + 1).cast("string"))
    body = F.to_json(
        F.struct("rows", F.struct("upto").alias("seen"), F.struct(following.alias("after")).alias("more")),
        {"ignoreNullFields": "false"},
    )
    bodies = grouped.select("endpoint", "page", body.alias("body"))
    bodies.write.partitionBy("endpoint", "page").option("lineSep", "\n").text(path)
    address = F.concat(F.lit(f"{HOST}/"), F.col("endpoint").cast("string")).alias("url")
    return path, grouped.select("endpoint").distinct().select(address)


def api(**settings) -> PagedSource:
    return PagedSource(HOST, next_page_path="more.after", **settings)


def page_rows(spark, pages):
    stored = pages.materialized(scratch_path(spark, "responses"))
    flat = FlattenDocument(["pages"], "explode")(stored.documents()).frame()
    names = {f"`rows.{c}`": c for c in ("page_id", "url", "html")}
    return stored, flat.select(*[F.col(a).alias(b) for a, b in names.items()])


@query("src_pages", "SELECT page_id, url, html FROM pages")
def src_pages(load, spark):
    folder, endpoints = page_files(load, spark)
    return page_rows(spark, api().read(endpoints, PageFiles(folder, 0, PAGES)))[1]


@query("src_pages_whole", "SELECT page_id, url, html FROM pages")
def src_pages_whole(load, spark):
    """The default record path: every endpoint is one document, exploded page by page."""
    folder, endpoints = page_files(load, spark)
    pages = api().read(endpoints, PageFiles(folder, 0, PAGES)).materialized(scratch_path(spark, "responses"))
    flat = FlattenDocument([], "explode")(pages.documents()).frame()
    return flat.select(*[F.col(f"`pages.rows.{c}`").alias(c) for c in ("page_id", "url", "html")])


@query(
    "src_pages_incremental",
    """SELECT page_id, url, html, CASE WHEN page_id % 50 < 30 THEN 1 ELSE 2 END AS run,
       max(CASE WHEN page_id % 50 < 30 THEN page_id END) OVER (PARTITION BY page_id // 50) AS mark FROM pages""",
)
def src_pages_incremental(load, spark):
    """A first run sees three pages of every endpoint, the next one what came later."""
    folder, endpoints = page_files(load, spark)
    source = api(checkpoint_path="seen.upto", checkpoint_parameter="since")
    first, one = page_rows(spark, source.read(endpoints, PageFiles(folder, 0, 2)))
    marks = first.checkpoints().select(F.col("endpoint").alias("url"), "value")
    second, two = page_rows(spark, source.read(marks, PageFiles(folder, 3, PAGES)))
    both = one.withColumn("run", F.lit(1)).unionByName(two.withColumn("run", F.lit(2)))
    number = F.concat(F.lit(f"{HOST}/"), F.floor(F.col("page_id") / (PAGE_ROWS * PAGES)).cast("string"))
    return (
        both.join(marks, number == marks["url"])
        .select("page_id", both["url"], "html", "run", F.col("value").cast("bigint").alias("mark"))
    )


@query("stream_pages", "SELECT page_id, url, html, CASE WHEN page_id % 50 < 30 THEN 1 ELSE 2 END AS run FROM pages")
def stream_pages(load, spark):
    """Two runs of one stream: the second goes on from the offsets of the first."""
    folder, endpoints = page_files(load, spark)
    addresses = [r.url for r in endpoints.collect()]
    source = api(checkpoint_path="seen.upto", checkpoint_parameter="since")
    out, state, rounds = (scratch_path(spark, name) for name in ("streamed", "offsets", "rounds"))
    for first, last in ((0, 2), (3, PAGES)):
        pages = page_stream(spark, source, addresses, rounds, PageFiles(folder, first, last))
        batch = pages.writeStream.format("parquet").option("checkpointLocation", state)
        batch.trigger(availableNow=True).start(out).awaitTermination()
    stored = spark.read.parquet(out)
    runs = [page_rows(spark, Pages(stored.where(F.col("round") == n)))[1].withColumn("run", F.lit(n)) for n in (1, 2)]
    return runs[0].unionByName(runs[1])


# -- tables ------------------------------------------------------------------------


@query("src_table", "SELECT * FROM supplier")
def src_table(load, spark):
    load("supplier").createOrReplaceTempView("millrace_supplier")
    return RelationalSource(table="millrace_supplier")(spark, CatalogDatabase()).frame()


@query("src_query", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def src_query(load, spark):
    load("customer").createOrReplaceTempView("millrace_customer")
    sql = "SELECT c_custkey, c_acctbal FROM millrace_customer WHERE c_acctbal > 0 ORDER BY c_custkey"
    return RelationalSource(query=sql)(spark, CatalogDatabase()).frame()


@query(
    "src_incremental",
    "SELECT *, CASE WHEN ts <= TIMESTAMP '2024-01-20 12:00:00' THEN 1 ELSE 2 END AS run FROM events",
)
def src_incremental(load, spark):
    """Two runs over a growing table; the second starts after the greatest time seen."""
    events = load("events")
    source = RelationalSource(table="millrace_events", checkpoint_column="ts")
    events.where("ts <= TIMESTAMP_NTZ'2024-01-20 12:00:00'").createOrReplaceTempView("millrace_events")
    path = scratch_path(spark, "extract")
    source(spark, CatalogDatabase()).frame().write.parquet(path)
    one = spark.read.parquet(path)
    checkpoint = source.candidate(one)
    events.createOrReplaceTempView("millrace_events")
    two = source(spark, CatalogDatabase(), checkpoint).frame()
    return one.withColumn("run", F.lit(1)).unionByName(two.withColumn("run", F.lit(2)))


@query(
    "src_query_incremental",
    "SELECT event_id, ts FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE user_id < 75)",
)
def src_query_incremental(load, spark):
    """A query that places the checkpoint value itself."""
    load("events").createOrReplaceTempView("millrace_events")
    sql = "SELECT event_id, ts FROM millrace_events WHERE event_id > %(checkpoint)s ORDER BY event_id"
    source = RelationalSource(query=sql, checkpoint_column="event_id")
    seen = source.candidate(load("events").where("user_id < 75").select("event_id"))
    return source(spark, CatalogDatabase(), seen).frame()


@query(
    "inc_values",
    """SELECT max(event_id)::VARCHAR AS whole, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS plain_time,
       strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS zoned_time,
       max(event_type) AS word, max(round(value * 100)::BIGINT)::VARCHAR || '.00' AS exact FROM events""",
)
def inc_values(load, spark):
    """Checkpoint values of several column types, as they are stored."""
    events = load("events").selectExpr(
        "event_id AS whole", "ts AS plain_time", "CAST(ts AS TIMESTAMP) AS zoned_time",
        "event_type AS word", "CAST(CAST(round(value * 100) AS BIGINT) AS DECIMAL(18, 2)) AS exact",
    )
    values = {
        c: RelationalSource(table="events", checkpoint_column=c).candidate(events)["value"]
        for c in events.columns
    }
    return spark.createDataFrame([tuple(map(str, values.values()))], events.columns)


@query("src_dataset", "SELECT * FROM orders")
def src_dataset(load, spark):
    store = DatasetStore(spark, scratch_path(spark, "store"))
    table = ordered(load("orders"), "o_orderkey")
    descriptor = store.persist(table, Lifecycle("orders", "run"))
    return store.table(descriptor.id).frame()
