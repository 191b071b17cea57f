import math

import pytest
from pyspark.sql import functions as F

from millrace import (
    ConfigError,
    DeduplicateRows,
    DropColumns,
    FilterRows,
    LimitRows,
    SchemaError,
    SortRows,
    Table,
)

from millrace.functions.selection import counted_ranges, first_rows

DATA = [(4, 2, "d"), (1, None, "a"), (3, 1, "c"), (1, None, "b")]


@pytest.fixture
def table(spark):
    data = [(place, *row) for place, row in enumerate(DATA)]
    df = spark.createDataFrame(data, "place int, id bigint, priority bigint, name string")
    return DropColumns(["place"])(Table.of(df.repartition(3), ["place"]))


def names(table):
    return [r["name"] for r in table.ordered_frame().collect()]


@pytest.mark.parametrize(
    ("operator", "value", "kept"),
    [
        ("equals", 2, ["d"]),
        ("notEquals", 2, ["c"]),
        ("greaterThan", 1, ["d"]),
        ("greaterThanOrEqual", 1, ["d", "c"]),
        ("lessThan", 1.5, ["c"]),
        ("lessThanOrEqual", 2, ["d", "c"]),
        ("isNull", None, ["a", "b"]),
        ("isNotNull", None, ["d", "c"]),
    ],
)
def test_filter(table, operator, value, kept):
    assert names(FilterRows("priority", operator, value)(table)) == kept


def test_filter_orders_nan_last(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,)], "x double")
    assert FilterRows("x", "greaterThan", 1.0)(Table.of(df)).frame().count() == 2


@pytest.mark.parametrize(
    ("column", "value"), [("priority", "2"), ("name", 1), ("id", True), ("gone", 1)]
)
def test_filter_values_must_fit_the_column(table, column, value):
    with pytest.raises(SchemaError) as error:
        FilterRows(column, "equals", value)(table)
    assert repr(value) not in str(error.value)


@pytest.mark.parametrize(
    ("operator", "value"),
    [("isNull", 1), ("equals", None), ("equals", [1]), ("like", "a"), ("equals", math.nan)],
)
def test_filter_configurations(operator, value):
    with pytest.raises(ConfigError):
        FilterRows("id", operator, value)


def test_deduplicate_keeps_the_input_order(table):
    assert names(DeduplicateRows(["id"])(table)) == ["d", "a", "c"]
    assert names(DeduplicateRows(["id"], keep="last")(table)) == ["d", "c", "b"]
    assert names(DeduplicateRows(["id"], keep="none")(table)) == ["d", "c"]
    assert names(DeduplicateRows(["priority"])(table)) == ["d", "a", "c"]


def test_deduplicate_over_all_columns_ignores_the_order_columns(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "n int, v string")
    table = DropColumns(["n"])(Table.of(df, ["n"]))
    assert [r.v for r in DeduplicateRows()(table).ordered_frame().collect()] == ["x", None, "y"]
    single = DeduplicateRows(keep="none")(table).ordered_frame().collect()
    assert [r.v for r in single] == ["y"]


def test_deduplicate_needs_an_order_and_unique_keys(spark, table):
    with pytest.raises(SchemaError):
        DeduplicateRows(["id"])(Table.of(table.frame()))
    with pytest.raises(ConfigError):
        DeduplicateRows(["id", "id"])
    with pytest.raises(SchemaError):
        DeduplicateRows(["gone"])(table)


def test_deduplicate_ranks_before_the_shuffle(table):
    plan = DeduplicateRows(["id"])(table).df._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert plan.index("Final") < plan.rindex("Partial")


def test_sort_is_stable_with_nulls_first_both_ways(table):
    assert names(SortRows([{"column": "priority"}])(table)) == ["a", "b", "c", "d"]
    down = SortRows([{"column": "priority", "descending": True}])(table)
    assert names(down) == ["a", "b", "d", "c"]
    again = SortRows([{"column": "id", "descending": True}])(down)
    assert names(again) == ["d", "c", "a", "b"]


def test_sort_survives_dropping_its_key(table):
    out = DropColumns(["id", "priority"])(SortRows([{"column": "id"}])(table))
    assert out.columns == ["name"]
    assert names(LimitRows(3)(out)) == ["a", "b", "c"]


def test_limit(table):
    assert names(LimitRows(2)(table)) == ["d", "a"]
    assert names(LimitRows(0)(table)) == []
    with pytest.raises(ConfigError):
        LimitRows(-1)
    plan = LimitRows(2)(SortRows([{"column": "id"}])(table)).frame()
    assert "TakeOrderedAndProject" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "columns", [[], [{"column": "a"}, {"column": "a"}], [{"descending": True}], [{"column": "a", "x": 1}]]
)
def test_sort_configurations(columns):
    with pytest.raises(ConfigError):
        SortRows(columns)


def test_a_key_with_a_third_of_all_rows(spark):
    rows = [(i, 0 if i % 3 == 0 else i % 5000) for i in range(30_000)]
    df = spark.createDataFrame(rows, "place int, key int").repartition(6)
    table = Table.of(df, ["place"])
    by_key = {}
    for place, key in rows:
        by_key.setdefault(key, []).append(place)
    wanted = {
        "first": sorted(v[0] for v in by_key.values()),
        "last": sorted(v[-1] for v in by_key.values()),
        "none": sorted(v[0] for v in by_key.values() if len(v) == 1),
    }
    for keep, places in wanted.items():
        out = DeduplicateRows(["key"], keep=keep)(table)
        assert [r.place for r in out.ordered_frame().collect()] == places
    plan = DeduplicateRows(["key"], keep="none")(table).df._jdf.queryExecution().toString()
    assert "partial_count" in plan and "Window" not in plan


def test_keep_none_with_unique_keys_of_all_types(spark):
    rows = [(1, None, "a", 1.5), (2, 1, None, None), (3, 1, "b", None), (4, 2, None, float("nan"))]
    df = spark.createDataFrame(rows, "place int, key int, v string, x double")
    out = DeduplicateRows(["key"], keep="none")(Table.of(df, ["place"])).ordered_frame().collect()
    assert [(r.place, r.key, r.v) for r in out] == [(1, None, "a"), (4, 2, None)]
    assert out[1].x != out[1].x


def test_empty_tables(spark):
    table = Table.of(spark.createDataFrame([], "id bigint, v string"), ["id"])
    for operator in (
        FilterRows("id", "equals", 1),
        DeduplicateRows(["id"]),
        DeduplicateRows(keep="none"),
        SortRows([{"column": "v"}]),
        LimitRows(3),
    ):
        assert operator(table).ordered_frame().collect() == []


def test_a_large_limit_is_lazy_and_no_task_gets_all(spark):
    table = SortRows([{"column": "k"}])(Table.of(spark.range(0, 60_000, 1, 8).selectExpr("id", "id % 7 AS k"), ["id"]))
    cut = LimitRows(5000)(table)
    plan = cut.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "TakeOrderedAndProject" in plan
    got = [(r.k, r.id) for r in cut.sorted_frame().collect()]
    want = sorted(((i % 7, i) for i in range(60_000)))[:5000]
    assert got == want


def test_a_sort_of_few_keys_is_split(spark, scratch):
    df = spark.range(0, 40_000, 1, 4).selectExpr("id % 2 AS k", "id AS v")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    for table in (Table.of(df), Table.of(df, ["v"])):
        path = f"{scratch}/{len(table.order)}"
        sorted_ = SortRows([{"column": "k"}])(table)
        spark.conf.set(merging, "false")
        try:
            sorted_.sorted_frame().write.parquet(path)
        finally:
            spark.conf.unset(merging)
        sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_metadata.file_path").count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 25_000


def selection_rows(spark, n=3000):
    df = spark.range(n).select(
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 7).alias("k"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("t"), F.col("id") % 101)).alias("t"),
        F.when(F.col("id") % 13 == 0, float("nan")).otherwise(F.col("id") / 3).alias("x"),
        "id",
    )
    return df.repartition(6)


@pytest.mark.parametrize("count", [1, 600, 1501, 3000, 5000])
def test_selection_by_ranges_takes_the_first_rows(spark, count):
    table = SortRows([{"column": "k", "descending": True}, {"column": "t"}, {"column": "x", "descending": True}])(
        Table.of(selection_rows(spark), ["id"])
    )
    got = first_rows(table, count)
    want = [r.id for r in table.ordered_frame().collect()][:count]
    assert [r.id for r in got.ordered_frame().collect()] == want
    assert got.columns == table.columns and got.order == table.order


def test_selection_of_equal_keys_and_without_order(spark):
    same = spark.range(900).select(F.lit("a").alias("k"), "id")
    assert first_rows(Table.of(same, ["k"]), 333).frame().count() == 333
    rows = first_rows(Table.of(selection_rows(spark)), 1234)
    assert rows.columns == ["k", "t", "x", "id"] and not rows.order
    assert rows.frame().distinct().count() == rows.frame().count() == 1234
    assert first_rows(Table.of(same.limit(0), ["k"]), 5).frame().count() == 0


def test_a_limit_of_millions_is_lazy_and_ranks_few_rows(spark):
    count = 2_500_000
    source = spark.range(0, 3_000_000, 1, 8).select((F.col("id") * 7919 % 3_000_017).alias("key"), "id")
    table = Table.of(source, ["key"])
    started = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    cut = LimitRows(count)(table)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == started
    frame = cut.frame()
    # Checked by value: all rows up to the count-th key, none after it.
    keys = frame.agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last"), F.count_distinct("key").alias("d")).first()
    last = source.orderBy("key").offset(count - 1).limit(1).first().key
    assert (keys.n, keys.last, keys.d) == (count, last, count)
    # Only the sizes of ranges and the rows of the second cut meet in one task.
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CollectLimit" not in plan and "TakeOrdered" not in plan and "GlobalLimit" not in plan
    small = cut_sizes(spark, table, count)
    assert small < 3_000_000 / 4


def cut_sizes(spark, table, count):
    """Rows of the range that the first cut goes through; the second divides it again."""
    sizes = counted_ranges(table.df.select(*[k.column for k in table.order]), table.order, 8).orderBy("part").collect()
    assert len(sizes) == 8 and sum(s.n for s in sizes) == 3_000_000
    return max(s.n for s in sizes)
