import datetime as dt
import decimal
import math

import pytest

from millrace import (
    CastColumn,
    ConfigError,
    FillNull,
    NormalizeText,
    ReplaceValues,
    SchemaError,
    Table,
)


def column(spark, values, type_name):
    df = spark.createDataFrame(list(enumerate(values)), f"n int, v {type_name}")
    return Table.of(df, ["n"])


def values(table):
    return [r["v"] for r in table.ordered_frame().collect()]


def lenient(spark, data, type_name, target):
    return values(CastColumn("v", target, strict=False)(column(spark, data, type_name)))


def test_text_to_number(spark):
    texts = ["12", "-3", "+4", " 5", "6 ", "1.5", "1e3", "abc", "", None, "9223372036854775808"]
    assert lenient(spark, texts, "string", "integer") == [12, -3, 4] + [None] * 8
    floats = ["1.5", "1e3", ".5", "2.", "-inf", "x1", " 1", "1f"]
    assert lenient(spark, floats, "string", "float") == [1.5, 1000.0, 0.5, 2.0, -math.inf] + [None] * 3
    assert math.isnan(lenient(spark, ["-NaN"], "string", "float")[0])


def test_text_to_boolean_and_time(spark):
    assert lenient(spark, ["true", "false", "t", "yes", "1", "True"], "string", "boolean") == [
        True, False, None, None, None, None,
    ]
    assert lenient(spark, ["2024-02-29", "2023-02-29", "2024-2-1"], "string", "date") == [
        dt.date(2024, 2, 29), None, None,
    ]
    texts = ["2024-01-02T03:04:05.25", "2024-01-02 03:04", "2024-01-02", "noon"]
    assert lenient(spark, texts, "string", "datetime") == [
        dt.datetime(2024, 1, 2, 3, 4, 5, 250000),
        dt.datetime(2024, 1, 2, 3, 4),
        dt.datetime(2024, 1, 2),
        None,
    ]


def test_number_casts(spark):
    numbers = [1.9, -1.9, math.nan, 9.3e18, float(2**63), None]
    assert lenient(spark, numbers, "double", "integer") == [1, -1, None, None, None, None]
    assert lenient(spark, [0, 2], "bigint", "boolean") == [False, True]
    assert lenient(spark, [True, False], "boolean", "integer") == [1, 0]
    assert lenient(spark, [decimal.Decimal("2.75")], "decimal(8,2)", "integer") == [2]
    assert lenient(spark, [7], "int", "text") == ["7"]


def test_time_casts(spark):
    day, moment = dt.date(1970, 1, 11), dt.datetime(1969, 12, 31, 23, 59, 59, 500000)
    assert lenient(spark, [day], "date", "integer") == [10]
    assert lenient(spark, [moment], "timestamp_ntz", "integer") == [-500000]
    assert lenient(spark, [10], "bigint", "date") == [day]
    assert lenient(spark, [2**40], "bigint", "date") == [None]
    assert lenient(spark, [-500000], "bigint", "datetime") == [moment]
    assert lenient(spark, [moment], "timestamp_ntz", "date") == [dt.date(1969, 12, 31)]
    assert lenient(spark, [moment], "timestamp_ntz", "text") == ["1969-12-31 23:59:59.500000"]
    with pytest.raises(SchemaError):
        CastColumn("v", "boolean")(column(spark, [day], "date"))


def test_strict_cast_fails_without_naming_the_value(spark):
    table = column(spark, ["12", "s3cret"], "string")
    with pytest.raises(Exception, match="Column v holds values that are not integer") as error:
        CastColumn("v", "integer")(table).frame().collect()
    assert "s3cret" not in str(error.value)
    assert values(CastColumn("v", "integer")(column(spark, ["12", None], "string"))) == [12, None]


def test_replace_is_simultaneous_and_keeps_the_type(spark):
    table = column(spark, ["a", "b", "c", None], "string")
    assert values(ReplaceValues("v", {"a": "b", "b": "a"})(table)) == ["b", "a", "c", None]
    numbers = ReplaceValues("v", {"1": 10, "2": 20})(column(spark, [1, 2, 3], "bigint"))
    assert numbers.schema["v"].dataType.simpleString() == "bigint"
    assert values(numbers) == [10, 20, 3]
    flags = ReplaceValues("v", {"true": False})(column(spark, [True, False], "boolean"))
    assert values(flags) == [False, False]
    days = ReplaceValues("v", {"2024-01-01": "2025-01-01"})
    assert values(days(column(spark, [dt.date(2024, 1, 1)], "date"))) == [dt.date(2025, 1, 1)]


@pytest.mark.parametrize("replacements", [{"x": 1}, {"1": "x"}, {"1": 1.5}, {"1": True}, {"1": 2**70}])
def test_replacements_must_fit_the_column(spark, replacements):
    with pytest.raises(SchemaError):
        ReplaceValues("v", replacements)(column(spark, [1], "bigint"))


def test_fill_null(spark):
    assert values(FillNull("v", "none")(column(spark, ["a", None], "string"))) == ["a", "none"]
    widened = FillNull("v", 0.5)(column(spark, [1, None], "bigint"))
    assert values(widened) == [1.0, 0.5]
    filled = values(FillNull("v", 0.0)(column(spark, [math.nan, None], "double")))
    assert math.isnan(filled[0]) and filled[1] == 0.0
    with pytest.raises(SchemaError):
        FillNull("v", "0")(column(spark, [1], "bigint"))


def test_normalize(spark):
    text = " \t Äpfel\n\n und　 Birnen "
    table = column(spark, [text, None], "string")

    def normalized(operation):
        return values(NormalizeText("v", operation)(table))

    assert normalized("trim") == ["Äpfel\n\n und　 Birnen", None]
    assert normalized("normalizeWhitespace") == ["Äpfel und Birnen", None]
    assert normalized("lowercase") == [text.lower(), None]
    assert normalized("uppercase") == [text.upper(), None]
    assert values(NormalizeText("v", "trim")(column(spark, [12], "bigint"))) == ["12"]


def test_trim_knows_every_white_space_character(spark):
    from millrace.functions.text import WHITE_SPACE

    by_regex = spark.range(0, 0x10000).selectExpr("id").where(
        "id < 55296 OR id > 57343"
    ).selectExpr("id").collect()
    import regex

    expected = {chr(r.id) for r in by_regex if regex.fullmatch(r"\p{White_Space}", chr(r.id))}
    assert set(WHITE_SPACE) == expected and len(WHITE_SPACE) == 25


@pytest.mark.parametrize(
    "make",
    [
        lambda: CastColumn("v", "decimal"),
        lambda: CastColumn("", "text"),
        lambda: ReplaceValues("v", {}),
        lambda: ReplaceValues("v", {"a": None}),
        lambda: FillNull("v", None),
        lambda: FillNull("v", [1]),
        lambda: NormalizeText("v", "title"),
    ],
)
def test_configurations(make):
    with pytest.raises(ConfigError):
        make()


def test_missing_column(spark):
    table = column(spark, [1], "bigint")
    for operator in (
        CastColumn("w", "text"),
        ReplaceValues("w", {"1": 2}),
        FillNull("w", 1),
        NormalizeText("w", "trim"),
    ):
        with pytest.raises(SchemaError):
            operator(table)


def test_a_trailing_line_break_is_no_digit(spark):
    df = spark.createDataFrame([("5\n",), ("5",), (" 5",)], "v string")
    for target, value in (("integer", 5), ("float", 5.0)):
        table = CastColumn("v", target, strict=False)(Table.of(df))
        assert {r.v for r in table.frame().collect()} == {None, value}


def test_a_long_map_is_joined_and_keeps_everything_else(spark):
    data = [(i, None if i % 10 == 0 else f"k{i % 60}") for i in range(300)]
    table = Table.of(spark.createDataFrame(data, "n bigint, v string"), ["n"])
    long = {f"k{i}": f"new {i}" if i % 2 else i for i in range(50)}
    got = [tuple(r) for r in ReplaceValues("v", long)(table).sorted_frame().collect()]
    assert got == [(n, str(long[v]) if v in long else v) for n, v in data]
    short = {"k1": "x", "k2": "k1"}
    both = ReplaceValues("v", {**short, **{f"none{i}": "y" for i in range(40)}})(table)
    assert both.sorted_frame().collect() == ReplaceValues("v", short)(table).sorted_frame().collect()
