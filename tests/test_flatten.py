import itertools
import json
import random

import pytest

from millrace import ConfigError, DataError, Documents, FlattenDocument, SchemaError, Table
from millrace.functions.shapes import record_rows
from millrace.table import quoted


def documents(spark, bodies, parts=2):
    texts = [b if isinstance(b, str) else json.dumps(b, ensure_ascii=False) for b in bodies]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, body string")
    return Documents.of(df.repartition(parts), "body", ["n"])


def flat(spark, bodies, expect=None, **settings):
    operator = FlattenDocument(**settings)
    docs = documents(spark, bodies)
    shape = operator.discover(docs)
    if expect is not None:
        assert shape.typed == (expect == "typed")
    table = operator(docs, shape)
    # Order by every hidden column: rows must come out in document order.
    ordered = table.df.orderBy(*[k.ascending_column() for k in table.order])
    rows = ordered.select(*[quoted(c) for c in table.columns]).collect()
    return table.columns, [tuple(r) for r in rows]


ORDER = {
    "orders": [
        {
            "id": 31,
            "customer": {"name": "Núria"},
            "tags": ["new", "gift"],
            "lines": [{"sku": "p-1"}, {"sku": "p-2"}],
        }
    ]
}


def test_arrays_as_json_text(spark):
    columns, rows = flat(spark, [ORDER], "typed", record_path=["orders"])
    assert columns == ["id", "customer.name", "tags", "lines"]
    assert rows == [(31, "Núria", '["new","gift"]', '[{"sku":"p-1"},{"sku":"p-2"}]')]


def test_arrays_exploded(spark):
    columns, rows = flat(spark, [ORDER], "typed", record_path=["orders"], array_mode="explode")
    assert columns == ["id", "customer.name", "tags", "lines.sku"]
    assert [r[2:] for r in rows] == [
        ("new", "p-1"), ("new", "p-2"), ("gift", "p-1"), ("gift", "p-2"),
    ]


def test_array_text_is_compact_and_keeps_keys_and_nulls(spark):
    body = '{"a": [1, 2.50, {"z": null, "b": "\\u00e9 \\"x\\""}, [ ]]}'
    assert flat(spark, [body], "typed")[1] == [('[1,2.5,{"z":null,"b":"é \\"x\\""},[]]',)]
    large = '{"a": [1e20, 12345678.0, 0.00001], "b": 1}'
    assert flat(spark, [large], "python")[1] == [("[1e+20,12345678.0,1e-05]", 1)]


def test_types_merge_over_all_records(spark):
    bodies = [{"a": 1, "b": None}, {"a": 2.5, "c": True}, {"b": "3"}]
    columns, rows = flat(spark, bodies, "typed")
    assert columns == ["a", "b", "c"]
    assert rows == [(1.0, None, None), (2.5, None, True), (None, "3", None)]
    with pytest.raises(DataError, match="different types"):
        flat(spark, [{"a": 3}, {"a": "3"}])


def test_keys_may_hold_dots_quotes_and_differ_in_case(spark):
    columns, rows = flat(spark, [{"a.b": 1, "it's?": {"`x`": 2}, "Id": 3, "id": 4}], "typed")
    assert columns == ["a.b", "it's?.`x`", "Id", "id"]
    assert rows == [(1, 2, 3, 4)]


def test_separator_and_empty_objects(spark):
    columns, rows = flat(spark, [{"a": {"b": 1}, "c": {}}, {}], "typed", separator="__")
    assert columns == ["a__b"] and rows == [(1,), (None,)]
    assert flat(spark, [{}, {}]) == ([], [(), ()])


def test_empty_arrays_drop_records_but_null_and_missing_do_not(spark):
    bodies = [{"a": 1, "t": []}, {"a": 2, "t": None}, {"a": 3}, {"a": 4, "t": [5, None]}]
    columns, rows = flat(spark, bodies, "typed", array_mode="explode")
    assert rows == [(2, None), (3, None), (4, 5), (4, None)]
    # A column only dropped records have does not exist.
    assert flat(spark, [{"x": 1, "t": []}, {"a": 1}], array_mode="explode")[0] == ["a"]


def test_arrays_of_mixed_elements(spark):
    bodies = [{"l": [{"a": 1}, 7, {"b": []}]}, {"l": 8}]
    columns, rows = flat(spark, bodies, "python", array_mode="explode")
    assert columns == ["l.a", "l"]
    assert rows == [(1, None), (None, 7), (None, 8)]


def test_a_null_object_makes_its_own_column(spark):
    columns, rows = flat(spark, [{"c": {"n": 1}}, {"c": None}], "typed")
    assert columns == ["c.n", "c"] and rows == [(1, None), (None, None)]


def test_records_of_one_or_many_documents(spark):
    bodies = ['[{"a":1},{"a":2}]', "[]", '[{"a":3}]']
    assert flat(spark, bodies, "typed")[1] == [(1,), (2,), (3,)]
    assert flat(spark, ['[{"a":1}]', '{"a":2}'], "python")[1] == [(1,), (2,)]
    assert flat(spark, [{"x": {"y": {"a": 1}}}], "typed", record_path=["x", "y"])[1] == [(1,)]


def test_columns_come_in_first_seen_order_whatever_the_partitions(spark):
    bodies = [{f"k{i}": i} for i in range(12)]
    assert flat(spark, bodies)[0] == [f"k{i}" for i in range(12)]


@pytest.mark.parametrize(
    ("body", "settings", "message"),
    [
        ({"rows": [{"v": [["x"]]}]}, {"record_path": ["rows"], "array_mode": "explode"}, "inside arrays"),
        ({"a.b": 1, "a": {"b": 2}}, {}, "same column"),
        ({"": 1}, {}, "must not be empty"),
        ([1], {}, "only objects"),
        ("7", {}, "object or an array"),
        ({"a": 1}, {"record_path": ["b"]}, "record path is not available"),
        ({"a": [{"b": 1}]}, {"record_path": ["a", "b"]}, "record path is not available"),
        ('{"a": 1', {}, "not valid JSON"),
        ('{"a": NaN}', {}, "not valid JSON"),
        ('{"a": 1} x', {}, "not valid JSON"),
        ({"a": 2**63}, {}, "64-bit"),
        ('{"a": 1e400}', {}, "range of a float"),
        ('{"a": ["\x7f", [1, -1e400]]}', {}, "range of a float"),
        ('{"a": "{\\"b\\": 1}"}', {"record_path": ["a"]}, "object or an array"),
    ],
)
def test_rejected_shapes(spark, body, settings, message):
    with pytest.raises(DataError, match=message):
        flat(spark, [body], **settings)


def test_repeated_keys_keep_the_last_value(spark):
    assert flat(spark, ['{"a":1,"b":2,"a":3}'], "typed") == (["a", "b"], [(3, 2)])


def test_a_known_shape_spares_the_discovery(spark):
    operator = FlattenDocument()
    shape = operator.discover(documents(spark, [{"a": 1, "b": "x"}]))
    table = operator(documents(spark, [{"b": "y", "c": 1}, {"a": 2}]), shape)
    got = [tuple(r) for r in table.sorted_frame().collect()]
    assert got == [(None, "y"), (2, None)]


def test_configurations(spark):
    with pytest.raises(SchemaError):
        flat(spark, [{"__ord_0": 1}])
    for settings in ({"separator": ""}, {"separator": "x" * 9}, {"array_mode": "zip"}, {"record_path": [" "]}):
        with pytest.raises(ConfigError):
            FlattenDocument(**settings)
    with pytest.raises(SchemaError):
        FlattenDocument()(Table.of(spark.range(1)))


# -- a model that enumerates every row ------------------------------------------


def model_rows(value, path):
    """All flat rows of a JSON value as lists of (column, value) pairs."""
    if isinstance(value, dict):
        parts = [model_rows(v, f"{path}.{k}" if path else k) for k, v in value.items()]
        rows = []
        for choice in itertools.product(*parts):
            rows.append([pair for part in choice for pair in part])
        return rows
    if isinstance(value, list):
        return [row for item in value for row in model_rows(item, path)]
    return [[(path, value)]]


def random_value(rng, depth):
    roll = rng.random()
    if depth and roll < 0.3:
        return {k: random_value(rng, depth - 1) for k in rng.sample("pqrs", rng.randint(0, 3))}
    if depth and roll < 0.5:
        items = [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
        return [i for i in items if not isinstance(i, list)]
    return rng.choice([None, 1, 2, 3])


@pytest.mark.parametrize("seed", range(12))
def test_random_documents_match_the_model(spark, seed):
    rng = random.Random(seed)
    bodies = []
    for _ in range(8):
        body = {k: random_value(rng, 3) for k in rng.sample("abcd", rng.randint(1, 4))}
        bodies.append(body)
    expected = [row for body in bodies for row in model_rows(body, "")]
    columns = list(dict.fromkeys(c for row in expected for c, _ in row))
    wanted = [tuple(dict(row).get(c) for c in columns) for row in expected]
    assert flat(spark, bodies, array_mode="explode") == (columns, wanted)


def regular_value(rng, key):
    if key == "a":
        return [rng.randint(0, 9) for _ in range(rng.randint(0, 2))]
    if key == "b":
        return [
            {"x": rng.randint(0, 9), "y": [rng.choice("uv") for _ in range(rng.randint(0, 2))]}
            for _ in range(rng.randint(0, 3))
        ]
    return {"m": rng.random() < 0.5, "n": rng.choice([None, 0.5])}


@pytest.mark.parametrize("seed", range(8))
def test_regular_documents_take_the_typed_plan(spark, seed):
    rng = random.Random(seed)
    bodies = [
        {k: regular_value(rng, k) for k in "abc" if rng.random() < 0.8} for _ in range(10)
    ]
    expected = [row for body in bodies for row in model_rows(body, "")]
    columns = list(dict.fromkeys(c for row in expected for c, _ in row))
    wanted = [tuple(dict(row).get(c) for c in columns) for row in expected]
    assert flat(spark, bodies, "typed", array_mode="explode") == (columns, wanted)


# -- what a reader must not lose ---------------------------------------------------


def big_number(digits):
    return "0." + "1" * digits


def test_long_texts_and_numbers_keep_their_documents(spark):
    long = "x" * 21_000_000
    docs = documents(spark, [f'{{"a":"{long}","b":1}}', f'{{"a":"s","b":{big_number(1200)}}}'])
    out = FlattenDocument()(docs).frame().selectExpr("length(a) AS a", "b").collect()
    assert sorted((r.a, round(r.b, 3)) for r in out) == [(1, 0.111), (21_000_000, 1.0)]
    wrapped = documents(spark, [f'{{"r":[{{"a":{big_number(1200)}}},{{"a":2}}]}}'])
    assert FlattenDocument(["r"])(wrapped).frame().count() == 2
    root = documents(spark, [f'[{{"a":{big_number(1200)},"t":[1,2,3]}}]'])
    assert FlattenDocument([], "explode")(root).frame().count() == 3


def test_no_key_is_special(spark):
    docs = documents(spark, ['{"_corrupt_record":"x","b":1}'])
    assert [tuple(r) for r in FlattenDocument()(docs).frame().collect()] == [("x", 1)]


def test_a_document_that_does_not_fit_is_an_error(spark):
    flatten = FlattenDocument()
    shape = flatten.discover(documents(spark, ['{"a":1}']))
    for body in ("no json", '{"a":"text"}'):
        with pytest.raises(Exception, match="could not be read"):
            flatten(documents(spark, [body]), shape).frame().collect()


def test_products_of_arrays_are_not_held_in_memory():
    def built(record, prefix=""):
        """The product as lists of all rows."""
        rows = [{}]
        for key, item in record.items():
            rows = [row | part for row in rows for part in offers(item, f"{prefix}.{key}" if prefix else key)]
        return rows

    def offers(item, column):
        if isinstance(item, dict):
            return built(item, column)
        if isinstance(item, list):
            return [part for element in item for part in offers(element, column)]
        return [{column: item}]

    rng = random.Random(5)

    def value(depth):
        kind = rng.random()
        if depth and kind < 0.3:
            return {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}
        if depth and kind < 0.6:
            element = (lambda: {f"e{i}": value(depth - 1) for i in range(rng.randrange(1, 3))}) if kind < 0.45 else rng.random
            return [element() for _ in range(rng.choice([0, 1, 1, 2, 3]))]
        return rng.choice([None, True, 1, "x"])

    records = [{f"c{i}": value(3) for i in range(rng.randrange(5))} for _ in range(500)]
    for record in records:
        got, want = list(record_rows(record, True, ".")), built(record)
        assert got == want and [list(r) for r in got] == [list(r) for r in want]
    assert any(len(built(r)) > 20 for r in records)

    wide = {"id": 7, "in": {x: list(range(200)) for x in "abcd"}}
    begin = list(itertools.islice(record_rows(wide, True, "."), 40_201))
    assert begin[0] == {"id": 7, "in.a": 0, "in.b": 0, "in.c": 0, "in.d": 0}
    assert begin[-1] == {"id": 7, "in.a": 0, "in.b": 1, "in.c": 1, "in.d": 0}
    singles = {f"s{i}": [i] for i in range(3000)}
    assert len(next(record_rows(singles, True, "."))) == 3000
