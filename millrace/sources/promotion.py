"""Type promotion of text columns, decided over all rows in one aggregation.

Unlike sampling, the decision never fails late; unlike Spark's inference it yields
64-bit numbers only and leaves dates as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..table import col

# The spellings a text column must have throughout to be promoted.
INTEGER = r"\A-?[0-9]+\z"
FLOAT = r"\A[+-]?([0-9]*\.[0-9]+([eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+|[0-9]+\.|inf|NaN)\z"
BOOLEAN = r"(?i)\A(true|false)\z"


def _is_integer(value: Column) -> Column:
    return value.rlike(INTEGER) & value.try_cast("bigint").isNotNull()


def promoted_types(df: DataFrame, columns: list[str], *extra: Column) -> tuple[dict[str, str], tuple]:
    """The type of every column and the values of further aggregates (one action)."""
    counts = []
    for i, name in enumerate(columns):
        value = col(name)
        integer, boolean = _is_integer(value), value.rlike(BOOLEAN)
        counts += [
            F.count(value).alias(f"filled_{i}"),
            F.count_if(integer).alias(f"integer_{i}"),
            F.count_if(integer | value.rlike(FLOAT)).alias(f"float_{i}"),
            F.count_if(boolean).alias(f"boolean_{i}"),
        ]
    row = df.agg(*counts, *[e.alias(f"extra_{i}") for i, e in enumerate(extra)]).first()
    types = {}
    for i, name in enumerate(columns):
        filled = row[f"filled_{i}"]
        types[name] = "string"
        if filled and row[f"integer_{i}"] == filled:
            types[name] = "bigint"
        elif filled and row[f"float_{i}"] == filled:
            types[name] = "double"
        elif filled and row[f"boolean_{i}"] == filled:
            types[name] = "boolean"
    return types, tuple(row[f"extra_{i}"] for i in range(len(extra)))


def promoted(name: str, type_name: str) -> Column:
    value = col(name)
    if type_name == "boolean":
        value = F.lower(value)
    return value.try_cast(type_name).alias(name) if type_name != "string" else value.alias(name)
