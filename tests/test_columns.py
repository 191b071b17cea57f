import pytest

from millrace import (
    ConfigError,
    DropColumns,
    RenameColumns,
    ReorderColumns,
    SchemaError,
    SelectColumns,
    Table,
)


@pytest.fixture
def table(spark):
    df = spark.createDataFrame(
        [(7, "Ada", 12.5), (8, "Brook", 3.0)], "id bigint, name string, `total.net` double"
    )
    return Table.of(df, ["id"])


def rows(table):
    return [tuple(r) for r in table.ordered_frame().collect()]


def test_select_uses_the_requested_order(table):
    out = SelectColumns(["total.net", "id"])(table)
    assert out.columns == ["total.net", "id"]
    assert rows(out) == [(12.5, 7), (3.0, 8)]


def test_rename_can_swap(table):
    out = RenameColumns({"id": "name", "name": "id"})(table)
    assert out.columns == ["name", "id", "total.net"]
    assert rows(out)[0] == (7, "Ada", 12.5)


def test_drop_and_reorder(table):
    assert DropColumns(["total.net"])(table).columns == ["id", "name"]
    assert DropColumns([])(table).columns == table.columns
    assert ReorderColumns(["name"])(table).columns == ["name", "id", "total.net"]


@pytest.mark.parametrize(
    "operator",
    [
        SelectColumns(["Id"]),
        RenameColumns({"gone": "x"}),
        RenameColumns({"id": "name"}),
        DropColumns(["gone"]),
        ReorderColumns(["gone"]),
        SelectColumns(["total"]),
    ],
)
def test_names_are_exact_and_checked_before_reading(table, operator):
    with pytest.raises(SchemaError):
        operator(table)


@pytest.mark.parametrize(
    "make",
    [
        lambda: SelectColumns([]),
        lambda: SelectColumns(["a", "a"]),
        lambda: RenameColumns({"a": "c", "b": "c"}),
        lambda: DropColumns(["a", "a"]),
        lambda: DropColumns([""]),
    ],
)
def test_configurations_are_checked(make):
    with pytest.raises(ConfigError):
        make()


def test_names_that_differ_in_case_are_two_columns(spark):
    df = spark.createDataFrame([(1, 2)], "Id bigint, id bigint")
    assert rows(SelectColumns(["id"])(Table.of(df))) == [(2,)]
