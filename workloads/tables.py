"""Column, row and value operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import (
    CastColumn,
    DeduplicateRows,
    DropColumns,
    FillNull,
    FilterRows,
    LimitRows,
    NormalizeText,
    RenameColumns,
    ReorderColumns,
    ReplaceValues,
    SelectColumns,
    SortRows,
    Table,
)
from millrace.functions.positions import numbered
from millrace.functions.selection import first_rows

from .registry import ordered, query

LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"

# -- projections -------------------------------------------------------------------


@query("prj_select", "SELECT l_shipdate, l_extendedprice, l_orderkey FROM lineitem")
def prj_select(load, spark):
    return SelectColumns(["l_shipdate", "l_extendedprice", "l_orderkey"])(Table.of(load("lineitem"))).frame()


@query(
    "prj_rename",
    """SELECT o_orderkey, o_custkey, o_orderpriority AS o_orderstatus, o_totalprice AS "total.net",
       o_orderdate, o_orderstatus AS o_orderpriority FROM orders""",
)
def prj_rename(load, spark):
    renames = {
        "o_orderstatus": "o_orderpriority",
        "o_orderpriority": "o_orderstatus",
        "o_totalprice": "total.net",
    }
    return RenameColumns(renames)(Table.of(load("orders"))).frame()


@query("prj_drop", "SELECT event_id, ts, user_id, value FROM events")
def prj_drop(load, spark):
    return DropColumns(["props", "event_type"])(Table.of(load("events"))).frame()


@query("prj_reorder", "SELECT c_mktsegment, c_acctbal, c_custkey, c_name, c_nationkey FROM customer")
def prj_reorder(load, spark):
    return ReorderColumns(["c_mktsegment", "c_acctbal"])(Table.of(load("customer"))).frame()


# -- filters -----------------------------------------------------------------------

NULLED_SQL = f"""SELECT {LINE}, l_shipdate,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag
  FROM lineitem"""


def nulled(load):
    """Line items with nulls in a number and a text column."""
    return Table.of(
        load("lineitem").select(
            *LINE.split(", "),
            "l_shipdate",
            F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("l_quantity"),
            F.when(F.col("l_linenumber") % 4 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        )
    )


FILTERS = {
    "equals": ("l_returnflag", "R", "l_returnflag = 'R'"),
    "notEquals": ("l_returnflag", "R", "l_returnflag <> 'R'"),
    "greaterThan": ("l_quantity", 40, "l_quantity > 40"),
    "greaterThanOrEqual": ("l_quantity", 40, "l_quantity >= 40"),
    "lessThan": ("l_quantity", 12.5, "l_quantity < 12.5"),
    "lessThanOrEqual": ("l_quantity", 12, "l_quantity <= 12"),
    "isNull": ("l_quantity", None, "l_quantity IS NULL"),
    "isNotNull": ("l_returnflag", None, "l_returnflag IS NOT NULL"),
}


def _register_filter(operator, column, value, condition):
    @query(f"flt_{operator}", f"SELECT * FROM ({NULLED_SQL}) WHERE {condition}")
    def run(load, spark):
        return FilterRows(column, operator, value)(nulled(load)).frame()


for _operator, (_column, _value, _condition) in FILTERS.items():
    _register_filter(_operator, _column, _value, _condition)


@query(
    "flt_chain",
    "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'A' AND l_discount < 0.05",
)
def flt_chain(load, spark):
    table = Table.of(load("lineitem"))
    for operator in (
        FilterRows("l_quantity", "greaterThanOrEqual", 10),
        FilterRows("l_returnflag", "equals", "A"),
        FilterRows("l_discount", "lessThan", 0.05),
        SelectColumns(["l_orderkey", "l_extendedprice"]),
    ):
        table = operator(table)
    return table.frame()


# -- deduplicate -------------------------------------------------------------------

RANKED = """SELECT * FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {}) = 1"""


@query("ded_first", RANKED.format("ASC"))
def ded_first(load, spark):
    return DeduplicateRows(["user_id", "event_type"])(ordered(load("events"), "event_id")).frame()


@query("ded_last", RANKED.format("DESC"))
def ded_last(load, spark):
    table = ordered(load("events"), "event_id")
    return DeduplicateRows(["user_id", "event_type"], keep="last")(table).frame()


@query("ded_none", "SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1")
def ded_none(load, spark):
    return DeduplicateRows(["l_orderkey"], keep="none")(Table.of(load("lineitem"))).frame()


@query("ded_all_columns", "SELECT DISTINCT text, lang FROM documents")
def ded_all_columns(load, spark):
    table = SelectColumns(["text", "lang"])(ordered(load("documents"), "doc_id"))
    return DeduplicateRows()(table).frame()


@query(
    "ded_text_first",
    """SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def ded_text_first(load, spark):
    return DeduplicateRows(["text"])(ordered(load("documents"), "doc_id")).frame()


# -- sort and limit ----------------------------------------------------------------

SORTABLE_SQL = """SELECT o_orderkey, o_totalprice,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderdate END AS day FROM orders"""
SORTED = "priority ASC NULLS FIRST, day DESC NULLS FIRST, o_orderkey"


def sortable(load):
    df = load("orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderdate")).alias("day"),
    )
    keys = [{"column": "priority"}, {"column": "day", "descending": True}]
    return SortRows(keys)(ordered(df, "o_orderkey"))


@query(
    "srt_multi",
    f"SELECT *, row_number() OVER (ORDER BY {SORTED}) - 1 AS place FROM ({SORTABLE_SQL})",
)
def srt_multi(load, spark):
    return numbered(sortable(load), "place").frame()


@query(
    "srt_few_keys",
    """SELECT l_returnflag, first::BIGINT AS first, (first + n - 1)::BIGINT AS last FROM (
         SELECT l_returnflag, n, sum(n) OVER (ORDER BY l_returnflag) - n AS first
         FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1))""",
)
def srt_few_keys(load, spark):
    """A table without any order of its own, sorted by a key of three values."""
    table = SortRows([{"column": "l_returnflag"}])(Table.of(load("lineitem")))
    placed = numbered(table, "place").frame()
    return placed.groupBy("l_returnflag").agg(F.min("place").alias("first"), F.max("place").alias("last"))


@query("lim_topk", f"SELECT * FROM ({SORTABLE_SQL}) ORDER BY {SORTED} LIMIT 250")
def lim_topk(load, spark):
    return LimitRows(250)(sortable(load)).frame()


@query("lim_head", "SELECT * FROM events ORDER BY event_id LIMIT 500")
def lim_head(load, spark):
    return LimitRows(500)(ordered(load("events"), "event_id")).frame()


@query("lim_parallel", f"SELECT * FROM ({SORTABLE_SQL}) ORDER BY {SORTED} LIMIT 9000")
def lim_parallel(load, spark):
    return LimitRows(9000)(sortable(load)).frame()


@query("lim_selected", f"SELECT * FROM ({SORTABLE_SQL}) ORDER BY {SORTED} LIMIT 12345")
def lim_selected(load, spark):
    """The way of limits above a million rows: counts per key range, no task with all rows."""
    return first_rows(sortable(load), 12345).frame()


@query(
    "lim_selected_unordered",
    "SELECT least(count(*), 4000) AS n, least(count(*), 4000) AS different FROM events",
)
def lim_selected_unordered(load, spark):
    """A table without order: any 4,000 rows, each one once."""
    rows = first_rows(Table.of(load("events")), 4000).frame()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("different"))


# -- casts -------------------------------------------------------------------------


def cast(load, table, key, data_type, *expressions):
    """Cast every derived column of a table to one type, leniently."""
    df = load(table).selectExpr(key, *expressions)
    out = Table.of(df)
    for name in out.columns[1:]:
        out = CastColumn(name, data_type, strict=False)(out)
    return out.frame()


@query(
    "cast_integer",
    """SELECT event_id, trunc(value)::BIGINT AS from_float,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id + 7 END AS from_text,
       epoch_us(ts) AS from_datetime, (ts::DATE - DATE '1970-01-01')::BIGINT AS from_date,
       (value > 50)::BIGINT AS from_boolean FROM events""",
)
def cast_integer(load, spark):
    return cast(
        load, "events", "event_id", "integer",
        "value AS from_float",
        "CASE WHEN event_id % 3 = 0 THEN event_id || '.5' ELSE '+' || (event_id + 7) END AS from_text",
        "ts AS from_datetime", "CAST(ts AS DATE) AS from_date", "value > 50 AS from_boolean",
    )


@query(
    "cast_float",
    """SELECT l_orderkey, l_partkey::DOUBLE AS from_integer, l_extendedprice AS from_text,
       CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_quantity / 100 END AS from_bad_text,
       (l_returnflag = 'R')::INT::DOUBLE AS from_boolean FROM lineitem""",
)
def cast_float(load, spark):
    return cast(
        load, "lineitem", "l_orderkey", "float",
        "l_partkey AS from_integer", "CAST(l_extendedprice AS STRING) AS from_text",
        "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity || 'd' ELSE CAST(l_quantity AS INT) || 'e-2' END AS from_bad_text",
        "l_returnflag = 'R' AS from_boolean",
    )


@query(
    "cast_boolean",
    """SELECT o_orderkey, o_custkey % 4 <> 0 AS from_integer, true AS from_float,
       CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS from_text FROM orders""",
)
def cast_boolean(load, spark):
    return cast(
        load, "orders", "o_orderkey", "boolean",
        "o_custkey % 4 AS from_integer", "o_totalprice AS from_float",
        "CASE o_orderstatus WHEN 'O' THEN 'true' WHEN 'F' THEN 'false' ELSE 'yes' END AS from_text",
    )


@query(
    "cast_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS from_datetime,
       CASE WHEN o_custkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS from_text,
       strftime(DATE '1970-01-01' + (o_custkey % 20000)::INT, '%Y-%m-%d') AS from_integer FROM orders""",
)
def cast_date(load, spark):
    """Casts to date, shown as text."""
    dates = cast(
        load, "orders", "o_orderkey", "date",
        "o_orderdate AS from_datetime",
        "date_format(o_orderdate, IF(o_custkey % 2 = 0, 'yyyy-MM-dd', 'dd.MM.yyyy')) AS from_text",
        "o_custkey % 20000 AS from_integer",
    )
    table = Table.of(dates)
    for name in table.columns[1:]:
        table = CastColumn(name, "text")(table)
    return table.frame()


@query(
    "cast_datetime",
    """SELECT event_id, ts AS from_text, date_trunc('minute', ts) AS from_short_text,
       date_trunc('day', ts) AS from_date, make_timestamp(epoch_us(ts)) AS from_integer FROM events""",
)
def cast_datetime(load, spark):
    return cast(
        load, "events", "event_id", "datetime",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS from_text",
        "date_format(ts, 'yyyy-MM-dd HH:mm') AS from_short_text",
        "CAST(ts AS DATE) AS from_date", "unix_micros(CAST(ts AS TIMESTAMP)) AS from_integer",
    )


@query(
    "cast_text",
    """SELECT event_id, user_id::VARCHAR AS from_integer, (value > 50)::VARCHAR AS from_boolean,
       strftime(ts::DATE, '%Y-%m-%d') AS from_date,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS from_datetime FROM events""",
)
def cast_text(load, spark):
    return cast(
        load, "events", "event_id", "text",
        "user_id AS from_integer", "value > 50 AS from_boolean",
        "CAST(ts AS DATE) AS from_date", "ts AS from_datetime",
    )


@query("cast_strict", "SELECT o_orderkey, o_custkey, trunc(o_totalprice)::BIGINT AS o_totalprice FROM orders")
def cast_strict(load, spark):
    df = load("orders").selectExpr("o_orderkey", "CAST(o_custkey AS STRING) AS o_custkey", "o_totalprice")
    table = CastColumn("o_custkey", "integer")(Table.of(df))
    return CastColumn("o_totalprice", "integer")(table).frame()


# -- values ------------------------------------------------------------------------


@query(
    "val_replace",
    """SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'O' THEN 'F' WHEN 'F' THEN 'O'
       ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def val_replace(load, spark):
    df = load("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return ReplaceValues("o_orderstatus", {"O": "F", "F": "O"})(Table.of(df)).frame()


@query(
    "val_replace_numbers",
    """SELECT l_orderkey, l_partkey, CASE l_linenumber WHEN 1 THEN 100 WHEN 2 THEN 1 ELSE l_linenumber END
       AS l_linenumber, CASE l_quantity WHEN 1 THEN 0.5 ELSE l_quantity END AS l_quantity FROM lineitem""",
)
def val_replace_numbers(load, spark):
    df = load("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    table = ReplaceValues("l_linenumber", {"1": 100, "2": 1})(Table.of(df))
    return ReplaceValues("l_quantity", {"1": 0.5})(table).frame()


@query(
    "val_fill_null",
    f"""SELECT {LINE}, l_shipdate, coalesce(l_quantity, -1) AS l_quantity,
        coalesce(l_returnflag, 'none') AS l_returnflag FROM ({NULLED_SQL})""",
)
def val_fill_null(load, spark):
    table = FillNull("l_quantity", -1)(nulled(load))
    return FillNull("l_returnflag", "none")(table).frame()


@query(
    "val_fill_widen",
    """SELECT l_orderkey, l_partkey,
       CASE WHEN l_linenumber % 3 = 0 THEN 0.5 ELSE l_suppkey::DOUBLE END AS l_suppkey FROM lineitem""",
)
def val_fill_widen(load, spark):
    supplier = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_suppkey")).alias("l_suppkey")
    df = load("lineitem").select("l_orderkey", "l_partkey", supplier)
    return FillNull("l_suppkey", 0.5)(Table.of(df)).frame()


PADDED_SQL = """SELECT doc_id, chr(9) || ' ' || replace(text, ' ', '  ' || chr(10)) || chr(10) || ' ' AS text
  FROM documents"""
NORMALIZED = {
    "trim": r"regexp_replace(text, '^[ \t\n]+|[ \t\n]+$', '', 'g')",
    "lowercase": "lower(text)",
    "uppercase": "upper(replace(text, 'ß', 'ss'))",
    "normalizeWhitespace": r"regexp_replace(regexp_replace(text, '^[ \t\n]+|[ \t\n]+$', '', 'g'), '[ \t\n]+', ' ', 'g')",
}


def _register_normalize(operation, expression):
    @query(f"norm_{operation}", f"SELECT doc_id, {expression} AS text FROM ({PADDED_SQL})")
    def run(load, spark):
        padded = F.concat(
            F.lit("\t "), F.replace("text", F.lit(" "), F.lit("  \n")), F.lit("\n ")
        )
        df = load("documents").select("doc_id", padded.alias("text"))
        return NormalizeText("text", operation)(Table.of(df)).frame()


for _operation, _expression in NORMALIZED.items():
    _register_normalize(_operation, _expression)
