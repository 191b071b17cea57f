import csv
import functools
import io
import json
import os
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import DataFrame

from millrace import ConfigError, DataError, FlattenDocument, SchemaError
from millrace.sources.delimited import DelimitedSource
from millrace.sources.documents import JsonSource
from millrace.sources.pages import PagedSource
from millrace.sources.quoted import lines_of, opened, split_parities
from millrace.sources.relational import JdbcDatabase, RelationalSource
from millrace.sources.workbook import WorkbookSource


def put(scratch, name, text):
    os.makedirs(os.path.dirname(f"{scratch}/{name}"), exist_ok=True)
    with open(f"{scratch}/{name}", "w", newline="") as file:
        file.write(text)


def rows(table):
    return [tuple(r) for r in table.sorted_frame().collect()]


def types(table):
    return [t for _, t in table.frame().dtypes]


# -- delimited --------------------------------------------------------------------


def test_csv_promotes_types_over_all_rows(spark, scratch):
    lines = ["id,price,flag,day,code"] + [f"{i},{i},true,2024-01-0{i},00{i}" for i in range(1, 5)]
    put(scratch, "a.csv", "\n".join([*lines, "5,2.5,FALSE,,x", ",,,,"]) + "\n")
    table = DelimitedSource("a.csv")(spark, scratch)
    assert types(table) == ["bigint", "double", "boolean", "string", "string"]
    assert rows(table)[-2:] == [(5, 2.5, False, None, "x"), (None,) * 5]


def test_csv_types_stay_text_where_a_promotion_would_lose(spark, scratch):
    put(scratch, "a.csv", "a,b,c,d\n 1,99999999999999999999,+5,yes\n2,1,6,no\n")
    assert types(DelimitedSource("a.csv")(spark, scratch)) == ["string"] * 4


def test_csv_without_header_and_with_another_separator(spark, scratch):
    put(scratch, "a.csv", "7;x\n8;y\n")
    table = DelimitedSource("a.csv", has_header=False, separator=";")(spark, scratch)
    assert table.columns == ["column_1", "column_2"]
    assert rows(table) == [(7, "x"), (8, "y")]


def test_csv_quotes_and_line_breaks(spark, scratch):
    put(scratch, "a.csv", 'id,text\n1,"a ""b"", c"\n2,"two\nlines"\n3,plain\n')
    table = DelimitedSource("a.csv")(spark, scratch)
    assert rows(table) == [(1, 'a "b", c'), (2, "two\nlines"), (3, "plain")]


def test_csv_keeps_the_order_over_splits_and_files(spark, scratch):
    for f in range(3):
        body = "".join(f"{i}\n" for i in range(f * 3000, (f + 1) * 3000))
        put(scratch, f"{f}.csv", "n\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        table = DelimitedSource("*.csv")(spark, scratch)
        assert table.df.rdd.getNumPartitions() > 3
        assert rows(table) == [(i,) for i in range(9000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_headers(spark, scratch):
    put(scratch, "a.csv", "\ufeffa.b,`x`,Id,id\r\n1,2,3,4\r\n")
    table = DelimitedSource("a.csv")(spark, scratch)
    assert table.columns == ["a.b", "`x`", "Id", "id"] and rows(table) == [(1, 2, 3, 4)]
    put(scratch, "b.csv", "id,v\n")
    assert types(DelimitedSource("b.csv")(spark, scratch)) == ["string", "string"]
    for number, text in enumerate(["", "a,a\n1,2\n", "a,\n1,2\n", "__ord_0\n1\n"]):
        put(scratch, f"bad{number}.csv", text)
        with pytest.raises((DataError, SchemaError)):
            DelimitedSource(f"bad{number}.csv")(spark, scratch)


def test_csv_text_is_taken_as_it_is(spark, scratch):
    put(scratch, "a.csv", 'v,w\n#a, x \n\\N,"b,\\c"\n')
    assert rows(DelimitedSource("a.csv")(spark, scratch)) == [("#a", " x "), ("\\N", "b,\\c")]


@pytest.mark.parametrize("path", ["/etc/a.csv", "../a.csv", "x/../../a.csv", "", ".", "s3:/a.csv"])
def test_paths_stay_below_the_root(path):
    for make in (DelimitedSource, JsonSource, WorkbookSource):
        with pytest.raises(ConfigError):
            make(path)


def test_csv_errors_hold_no_values(spark, scratch):
    put(scratch, "a.csv", "a,b\n1,2\ns3cret\n")
    with pytest.raises(DataError) as error:
        DelimitedSource("a.csv")(spark, scratch)
    assert "s3cret" not in str(error.value)
    with pytest.raises(DataError):
        DelimitedSource("gone.csv")(spark, scratch)
    with pytest.raises(ConfigError):
        DelimitedSource("a.csv", separator="::")


# -- JSON -------------------------------------------------------------------------


def test_json_documents_by_file_and_by_line(spark, scratch):
    put(scratch, "a.json", '{\n "orders": [{"id": 1}]\n}')
    put(scratch, "b.json", '{"orders": [{"id": 2}, {"id": 3}]}')
    table = FlattenDocument(["orders"])(JsonSource("*.json")(spark, scratch))
    assert rows(table) == [(1,), (2,), (3,)]
    put(scratch, "c.jsonl", '{"id": 4}\n{"id": 5}\n')
    lines = JsonSource("c.jsonl", layout="lines")(spark, scratch)
    assert rows(FlattenDocument()(lines)) == [(4,), (5,)]


@pytest.mark.parametrize("text", ['{"s3cret": 1', '{"a": 1} s3cret', "NaN", " "])
def test_json_is_checked(spark, scratch, text):
    put(scratch, "a.json", text)
    with pytest.raises(Exception, match="not valid JSON") as error:
        JsonSource("a.json")(spark, scratch).df.select("body").collect()
    assert "s3cret" not in str(error.value)


# -- workbooks --------------------------------------------------------------------

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheets, styles=()):
    """The bytes of a workbook; a cell is a value or (value, style)."""
    shared = []

    def cell(value, r, c):
        style = ""
        if isinstance(value, tuple):
            value, style = value[0], f' s="{value[1]}"'
        place = f'r="{chr(65 + c)}{r}"'
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c {place} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, str):
            shared.append(value)
            return f'<c {place} t="s"><v>{len(shared) - 1}</v></c>'
        return f"<c {place}{style}><v>{value}</v></c>"

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        listed, links = "", ""
        for i, (name, data) in enumerate(sheets.items(), 1):
            body = "".join(
                f'<row r="{r}">' + "".join(cell(v, r, c) for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(data, 1)
            )
            archive.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
            )
            listed += f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>'
            links += f'<Relationship Id="rId{i}" Type="t" Target="worksheets/sheet{i}.xml"/>'
        archive.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>',
        )
        archive.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        strings = "".join(f"<si><t>{s}</t></si>" for s in shared)
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        formats = "".join(f'<numFmt numFmtId="{n}" formatCode="{f}"/>' for n, f in styles)
        cells = "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, *[n for n, _ in styles]))
        archive.writestr(
            "xl/styles.xml",
            f'<styleSheet xmlns="{MAIN}"><numFmts>{formats}</numFmts>'
            f"<cellXfs>{cells}</cellXfs></styleSheet>",
        )
    return out.getvalue()


def put_book(scratch, name, *args, **kwargs):
    with open(f"{scratch}/{name}", "wb") as file:
        file.write(workbook(*args, **kwargs))


def test_workbook_named_sheet(spark, scratch):
    sheets = {"Prices": [["v"], [1]], "Stock": [["shelf", "weight"], [70, 0.25], [81, 6]]}
    put_book(scratch, "a.xlsx", sheets)
    table = WorkbookSource("a.xlsx", sheet_name="Stock")(spark, scratch)
    assert types(table) == ["bigint", "double"]
    assert rows(table) == [(70, 0.25), (81, 6.0)]


def test_workbook_first_sheet_without_header(spark, scratch):
    put_book(scratch, "a.xlsx", {"S": [[70, 0.25], [81, 6]]})
    table = WorkbookSource("a.xlsx", has_header=False)(spark, scratch)
    assert table.columns == ["column_1", "column_2"] and rows(table) == [(70, 0.25), (81, 6.0)]


def test_workbook_cell_types(spark, scratch):
    import datetime as dt

    data = [
        ["code", "flag", "day", "own", None],
        ["007", True, (45292, 1), (45292.5, 2), 1],
        [None] * 5,
        ["8", False, (45293, 1), (0.25, 3), "x"],
    ]
    put_book(scratch, "a.xlsx", {"S": data}, styles=[(170, "yyyy-mm"), (171, "0.0&quot;day&quot;")])
    table = WorkbookSource("a.xlsx")(spark, scratch)
    assert table.columns == ["code", "flag", "day", "own", "column_5"]
    assert types(table) == ["string", "boolean", "timestamp_ntz", "string", "string"]
    assert rows(table)[0][:3] == ("007", True, dt.datetime(2024, 1, 1))
    assert rows(table)[1][4] == "x"


def test_many_workbooks_are_one_table(spark, scratch):
    for i in range(5):
        put_book(scratch, f"{i}.xlsx", {"S": [["n"], *[[i * 10 + k] for k in range(10)]]})
    table = WorkbookSource("*.xlsx")(spark, scratch)
    assert rows(table) == [(n,) for n in range(50)]
    put_book(scratch, "9.xlsx", {"S": [["m"], [1]]})
    with pytest.raises(SchemaError, match="different columns"):
        WorkbookSource("*.xlsx")(spark, scratch)


def test_workbook_errors(spark, scratch):
    put_book(scratch, "a.xlsx", {"S": [["n"], [1]]})
    with pytest.raises(Exception, match="no sheet"):
        WorkbookSource("a.xlsx", sheet_name="T")(spark, scratch)
    put(scratch, "b.xlsx", "s3cret")
    with pytest.raises(Exception, match="could not be read") as error:
        WorkbookSource("b.xlsx")(spark, scratch)
    assert "s3cret" not in str(error.value)
    with pytest.raises(ConfigError):
        WorkbookSource("a.xlsx", sheet_name=" ")


# -- pages ------------------------------------------------------------------------

FIRST = "https://api.example.org/items?limit=2"


class FakeApi:
    """Pages by URL; picklable, and without a network."""

    def __init__(self, pages):
        self.pages = pages

    def __call__(self, url, headers):
        if url not in self.pages:
            raise OSError(url)
        return json.dumps(self.pages[url]).encode()


def page(ids, token, mark=None):
    return {"rows": [{"id": i} for i in ids], "more": {"after": token}, "seen": {"upto": mark}}


def paged(**settings):
    return PagedSource(FIRST, next_page_path="more.after", **settings)


def test_pages_follow_tokens(spark):
    api = FakeApi({FIRST: page([1, 2], "t2"), FIRST + "&page=t2": page([3], None)})
    pages = paged()(spark, api)
    document = pages.documents().assembled().df.select("body").collect()
    assert len(document) == 1
    assert [p["rows"] for p in json.loads(document[0]["body"])["pages"]] == [
        [{"id": 1}, {"id": 2}],
        [{"id": 3}],
    ]
    table = FlattenDocument(["pages"], "explode")(pages.documents())
    assert [r[0] for r in rows(table)] == [1, 2, 3]


def test_pages_of_many_endpoints_in_parallel(spark):
    bodies = {}
    for e in range(6):
        url = f"https://api.example.org/{e}"
        bodies[url] = page([e * 10], "n")
        bodies[url + "?page=n"] = page([e * 10 + 1], None)
    endpoints = spark.createDataFrame([(f"https://api.example.org/{e}",) for e in range(6)], "url string")
    pages = paged().read(endpoints, FakeApi(bodies), tasks=3)
    assert pages.rows.rdd.getNumPartitions() == 3
    table = FlattenDocument(["pages"], "explode")(pages.documents())
    assert [r[0] for r in rows(table)] == sorted(e * 10 + k for e in range(6) for k in range(2))
    assert pages.checkpoints().count() == 6


def test_page_checkpoints(spark):
    source = paged(checkpoint_path="seen.upto", checkpoint_parameter="since")
    first = {FIRST: page([1], "t", "Abc"), FIRST + "&page=t": page([2], None, "Def")}
    last = source(spark, FakeApi(first)).checkpoints().collect()
    assert [(r.pageToken, json.loads(r.value)) for r in last] == [(None, "Def")]
    second = {FIRST + "&since=Def": page([3], None, "Ghi")}
    again = source(spark, FakeApi(second), {"pageToken": None, "value": "Def"})
    assert json.loads(again.checkpoints().first().value) == "Ghi"
    with pytest.raises(DataError):
        source(spark, FakeApi(second), {"other": 1})


@pytest.mark.parametrize(
    ("pages", "message"),
    [
        ({FIRST: page([1], "t"), FIRST + "&page=t": page([1], "t")}, "More pages"),
        ({FIRST: {"data": []}}, "configured path"),
        ({FIRST: page([1], 7)}, "token must be text"),
        ({}, "request failed"),
    ],
)
def test_page_errors(spark, pages, message):
    with pytest.raises(Exception, match=message) as error:
        paged(max_pages=2)(spark, FakeApi(pages)).rows.collect()
    assert "limit=2" not in str(error.value)


@pytest.mark.parametrize(
    "settings",
    [
        {"url": "ftp://x/y"},
        {"url": "https://u:p@x/y"},
        {"url": "https://x/y?api_key=1"},
        {"url": "https://x", "path": "/abs"},
        {"url": "https://x", "path": "a/../../b"},
        {"url": "https://x", "path": "a?b=1"},
        {"url": "https://x", "headers": {"Authorization": "x"}},
        {"url": "https://x", "headers": {"Cookie": "x"}},
        {"url": "https://x", "query_params": {"access_token": "x"}},
        {"url": "https://x", "query_params": {"a": 1}},
        {"url": "https://x", "max_pages": 0},
        {"url": "https://x", "max_pages": 1001},
        {"url": "https://x", "checkpoint_path": "a"},
        {"url": "https://x", "checkpoint_parameter": "a"},
        {"url": "https://x", "next_page_path": "a..b"},
    ],
)
def test_page_configurations(settings):
    with pytest.raises(ConfigError):
        PagedSource(**settings)


# -- limits that must not be there -------------------------------------------------


def put(scratch, name, text):
    os.makedirs(os.path.dirname(f"{scratch}/{name}"), exist_ok=True)
    with open(f"{scratch}/{name}", "w", newline="") as file:
        file.write(text)


def test_csv_columns_and_values_are_not_special(spark, scratch):
    put(scratch, "a.csv", 'n,_corrupt_record\n1,\ufdd0\n2,""\n3,\n')
    table = DelimitedSource("a.csv")(spark, scratch)
    assert rows(table) == [(1, "\ufdd0"), (2, ""), (3, None)]


def test_padded_and_broken_digits_stay_text(spark, scratch):
    put(scratch, "a.csv", 'a,b,c\n"1\n", 2,3\n"4",5,6\n')
    table = DelimitedSource("a.csv")(spark, scratch)
    assert types(table) == ["string", "string", "bigint"]


def test_an_empty_file_is_no_document(spark, scratch):
    os.makedirs(f"{scratch}/docs")
    put(scratch, "docs/a.json", '{"a":1}')
    put(scratch, "docs/_SUCCESS", "")
    assert JsonSource("docs")(spark, scratch).df.count() == 1
    put(scratch, "docs/b.json", "")
    with pytest.raises(DataError, match="not valid JSON"):
        JsonSource("docs")(spark, scratch)


def test_pages_explode_without_being_assembled(spark):
    api = FakeApi({FIRST: page([1, 2], "t2"), FIRST + "&page=t2": page([3], None)})
    documents = paged()(spark, api).documents()
    table = FlattenDocument([], "explode")(documents)
    whole = FlattenDocument([], "explode")(documents.assembled())
    assert table.columns == whole.columns and "pages.rows.id" in table.columns
    assert rows(table) == rows(whole) and len(rows(table)) == 3
    assert "collect_list" not in table.df._jdf.queryExecution().toString()


def test_partition_column_by_configuration():
    source = RelationalSource("jdbc:x", table="t", partition_column="k")
    assert source.partition_column == "k"
    with pytest.raises(ConfigError):
        RelationalSource("jdbc:x", table="t", partition_column="k; drop")


class Answering:
    """Answers statements from an in-memory table of this process and keeps their texts."""

    def __init__(self, spark, rows, kind):
        self.statements, self.schema = [], f"id bigint, at {kind}, name string"
        self.connection = duckdb.connect()
        self.connection.execute(f'CREATE TABLE t (id BIGINT, "at" {kind}, name VARCHAR)')
        self.connection.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)

    def __call__(self, spark, options, predicates=None):
        if predicates is None:
            texts = [options["query"]]
        else:
            texts = [f"SELECT * FROM {options['dbtable']} WHERE {p}" for p in predicates]
        self.statements.append(texts)
        found = [self.connection.execute(t).fetchall() for t in texts]
        self.sizes = [len(rows) for rows in found]
        kind = self.schema.split(",")[1].split()[1]
        schema = self.schema if predicates is not None else f"low {kind}, high {kind}"
        frames = [spark.createDataFrame(rows, schema).coalesce(1) for rows in found]
        return functools.reduce(DataFrame.unionAll, frames)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_queries_are_read_in_slices_of_equal_size(spark, kind):
    made = [(i, None if i % 50 == 0 else (i * 7) % 400 // (2 if i % 3 else 1), "x") for i in range(1000)]
    if kind == "string":
        made = [(i, None if v is None else f"o'{v}", n) for i, v, n in made]
    answer = Answering(spark, made, kind)
    database = JdbcDatabase("jdbc:x", slice_column="at", connections=8, load=answer)
    df = database.query(spark, "SELECT * FROM t WHERE id >= 100 ORDER BY id", None, 10)
    assert sorted(tuple(r) for r in df.collect()) == [r for r in made if r[0] >= 100]
    assert 6 <= len(answer.sizes) <= 8 and max(answer.sizes) < 3 * sum(answer.sizes) / len(answer.sizes)
    (bounds,), slices = answer.statements
    assert bounds.count("NTILE(8)") == 1 and bounds.count("FROM (SELECT * FROM t WHERE id >= 100 ORDER BY id) wrapped") == 1
    assert slices[0].endswith('OR "at" IS NULL)') and ' <= ' in slices[-1]


def test_increments_are_sliced_by_their_checkpoint_and_leave_later_rows(spark):
    answer = Answering(spark, [(i, i // 2, "x") for i in range(400)], "bigint")

    class Growing:
        def __call__(self, spark, options, predicates=None):
            if predicates is not None:  # rows arrive after the bounds were read
                answer.connection.execute("INSERT INTO t SELECT 1000 + i, 500 + i, 'late' FROM range(20) s(i)")
            return answer(spark, options, predicates)

    source = RelationalSource("jdbc:x", table="t", checkpoint_column="at")
    database = JdbcDatabase("jdbc:x", slice_column="at", connections=4, load=Growing())
    got = source(spark, database, {"value": 149}).frame()
    assert sorted(r.at for r in got.collect()) == sorted(v for v in range(150, 200) for _ in range(2))
    assert 'WHERE "at" > 149' in answer.statements[0][0] and len(answer.statements[1]) == 4
    assert source.candidate(got) == {"value": 199}
    query = RelationalSource("jdbc:x", query='SELECT * FROM t WHERE "at" > %(checkpoint)s ORDER BY id', checkpoint_column="at")
    late = query(spark, database, {"value": 199}).frame()
    assert {r.name for r in late.collect()} == {"late"}
    nothing = query(spark, database, {"value": 10_000}).frame()
    assert nothing.count() == 0 and answer.statements[-1][0].endswith('"at" IS NULL')


def test_files_with_line_breaks_are_split_too(spark, scratch):
    os.makedirs(f"{scratch}/d")
    put(scratch, "d/a [1].csv", "n,v\n1,x\n2,y\n")
    put(scratch, "d/b c.csv", 'n,v\n3,"p\nq"\n4,z\n')
    table = DelimitedSource("d")(spark, scratch)
    assert rows(table) == [(1, "x"), (2, "y"), (3, "p\nq"), (4, "z")]
    plan = table.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "multiLine -> true" not in plan


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_split_ends(spark, scratch, small_splits, end):
    r = random.Random(4)
    words = ["a", "", 'q"q', "x,y", "two\nlines", "three\n\nlines\r\nor more", "é" * 40, "\n", '"', "end\r"]
    made = [(i, r.choice(words), r.choice(words) * r.randrange(1, 4)) for i in range(900)]
    made[450] = (450, "b", "\n".join(f'line {i} "quoted", more' for i in range(600)))  # over several splits
    for number in range(2):
        text = io.StringIO(newline="")
        out = csv.writer(text, lineterminator=end, quoting=csv.QUOTE_NONNUMERIC)
        out.writerow(["n", "v", "w"])
        out.writerows(made[number::2])
        put(scratch, f"{number}.csv", text.getvalue())
    table = DelimitedSource("*.csv")(spark, scratch)
    want = [(n, v, w) for k in range(2) for n, v, w in made[k::2]]
    assert rows(table) == want
    found = split_parities(lines_of(spark).text(scratch))
    assert len(found) > 20 and any(s.parity for s in found)
    starts = {(s.file, s.start) for s in found}
    assert {k for k, inside in opened(found).items() if inside} <= starts
    place = [k.column for k in table.order]
    assert table.df.select(*place[:2]).distinct().count() > 20


def test_quotes_inside_plain_fields_are_left_to_the_parser(spark, scratch, small_splits):
    body = "".join(f'{i},in"ch {i}\n' for i in range(500))
    put(scratch, "a.csv", "n,v\n" + body)
    put(scratch, "b.csv", 'n,v\n500,"ends\nwell"\n501,3" pipe\n502,4" pipe\n')
    put(scratch, "c.csv", 'n,v\n503,"x\ny"\n')
    table = DelimitedSource("*.csv")(spark, scratch)
    got = rows(table)
    assert [n for n, _ in got] == list(range(504))
    assert got[3] == (3, 'in"ch 3') and got[500] == (500, "ends\nwell") and got[501] == (501, '3" pipe')


def test_headers_of_split_files_must_agree(spark, scratch):
    put(scratch, "a.csv", 'n,v\n1,"a\nb"\n')
    put(scratch, "b.csv", 'n,w\n2,"c\nd"\n')
    with pytest.raises(Exception, match="header"):
        rows(DelimitedSource("*.csv")(spark, scratch))
    put(scratch, "b.csv", 'n,v\n2,"c\nd",3\n')
    with pytest.raises(DataError):
        DelimitedSource("*.csv")(spark, scratch)
    put(scratch, "c/one.csv", 'v\n"only\nthis"\n\nend\n')
    assert rows(DelimitedSource("c")(spark, scratch)) == [("only\nthis",), ("end",)]
    put(scratch, "e/none.csv", '1,"a\nb",\n,"",c\n')
    assert rows(DelimitedSource("e", has_header=False)(spark, scratch)) == [(1, "a\nb", None), (None, "", "c")]
