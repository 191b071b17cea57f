"""Type classes of columns and literals that fit them, decided at plan time.

Spark would cast `'abc' = 1` and fail while running, or fill a text value into
nothing at all.  Here a value that does not fit its column is a schema error.
"""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1

Scalar = str | int | float | bool


def class_of(data_type: T.DataType) -> str:
    """text, number, boolean, date, datetime or other."""
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.TimestampType | T.TimestampNTZType):
        return "datetime"
    return "other"


def class_of_value(value: Scalar) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, int | float) else "text"


def literal(value: Scalar) -> Column:
    """A literal in one of the types of the data model: 64-bit numbers, text, boolean."""
    if isinstance(value, bool) or isinstance(value, str):
        return F.lit(value)
    if isinstance(value, int):
        if not LONG_MIN <= value <= LONG_MAX:
            raise SchemaError("A configured number is outside the 64-bit range.")
        return F.lit(value).cast("bigint")
    return F.lit(float(value)).cast("double")


def fitting_literal(field: T.StructField, value: Scalar) -> Column:
    """A literal comparable with `field`, or a schema error."""
    if class_of(field.dataType) != class_of_value(value):
        raise SchemaError(f"The configured value does not fit the type of column {field.name}.")
    return literal(value)


def literal_as(field: T.StructField, value: Scalar) -> Column:
    """The value converted to exactly the type of `field`, or a schema error."""
    kind = class_of(field.dataType)
    try:
        if kind == "text":
            return F.lit(as_text(value)).cast(field.dataType)
        if kind == "boolean":
            return F.lit(_as_boolean(value))
        if kind == "number":
            return F.lit(_as_number(value, field.dataType)).cast(field.dataType)
        if kind == "date" and isinstance(value, str) and DATE.fullmatch(value):
            return F.expr(f"DATE'{value}'")
        if kind == "datetime" and isinstance(value, str) and DATETIME.fullmatch(value):
            return F.expr(f"TIMESTAMP_NTZ'{value}'").cast(field.dataType)
    except (ValueError, InvalidOperation):
        pass
    raise SchemaError(f"The configured value does not fit the type of column {field.name}.")


DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
DATETIME = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?")

_INTEGER_RANGE = {
    T.ByteType: 2**7,
    T.ShortType: 2**15,
    T.IntegerType: 2**31,
    T.LongType: 2**63,
}


def as_text(value: Scalar) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def _as_boolean(value: Scalar) -> bool:
    if isinstance(value, bool):
        return value
    if value in ("true", "false"):
        return value == "true"
    raise ValueError


def _as_number(value: Scalar, data_type: T.DataType) -> int | float | Decimal:
    if isinstance(value, bool):
        raise ValueError
    bound = _INTEGER_RANGE.get(type(data_type))
    if bound is None:
        return Decimal(str(value)) if isinstance(data_type, T.DecimalType) else float(value)
    number = int(value) if isinstance(value, str) else value
    if number != int(number) or not -bound <= number < bound:
        raise ValueError
    return int(number)
