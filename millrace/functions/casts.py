"""Conversions between the six scalar types as pure column expressions.

Spark's own casts trim spaces, take `yes` for true and read a timestamp as seconds.
Each conversion here is null for every value it rejects; `strict` turns such a null
into an error whose text holds no value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from .typed import class_of

# The names of the target types and what they are in Spark.
TARGETS = {
    "text": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
}

# The spellings text may have to become another type.
INTEGER_TEXT = r"\A[+-]?[0-9]+\z"
FLOAT_TEXT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
SPECIAL_FLOAT_TEXT = r"(?i)\A([+-]?inf|[+-]?infinity|[+-]?nan)\z"
DATE_TEXT = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DATETIME_TEXT = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?)?\z"
)

TWO_POW_63 = 9223372036854775808.0


def convert(value: Column, source: T.DataType, target: str, *, strict: bool, name: str) -> Column:
    """`value` as the target type; a value that does not convert is null or an error."""
    result = _lenient(value, source, target)
    if result is None:
        raise SchemaError(f"Column {name} cannot be cast to {target}.")
    if not strict or _total(source, target):
        return result
    failure = F.raise_error(F.lit(f"Column {name} holds values that are not {target}."))
    failed = value.isNotNull() & result.isNull()
    return F.when(failed, failure.cast(TARGETS[target])).otherwise(result)


def as_text(value: Column, source: T.DataType) -> Column:
    if isinstance(source, T.TimestampType | T.TimestampNTZType):
        return F.date_format(value.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return value if isinstance(source, T.StringType) else value.cast("string")


def _total(source: T.DataType, target: str) -> bool:
    """Conversions every non-null value passes need no error branch."""
    kind = class_of(source)
    if target == "text" or source == TARGETS[target]:
        return True
    integral = isinstance(source, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    if kind == "boolean" or target == "boolean" and kind == "number":
        return True
    if target in ("integer", "float"):
        return integral or kind in ("date", "datetime") or (target == "float" and kind == "number")
    return kind in ("date", "datetime") and target in ("date", "datetime")


def _lenient(value: Column, source: T.DataType, target: str) -> Column | None:
    kind = class_of(source)
    if kind == "other":
        return None
    if source == TARGETS[target]:
        return value
    if target == "text":
        return as_text(value, source)
    if kind == "text":
        return _from_text(value, target)
    if kind == "datetime":
        value = value.cast("timestamp_ntz")
    if target == "boolean":
        return None if kind in ("date", "datetime") else value.cast("boolean")
    if target == "integer":
        return _to_integer(value, source, kind)
    if target == "float":
        if kind in ("date", "datetime"):
            return _to_integer(value, source, kind).cast("double")
        return value.cast("double")
    if kind == "boolean":
        return None
    if target == "date":
        if kind == "number":
            days = _to_integer(value, source, kind).try_cast("int")
            return F.date_from_unix_date(days)
        return value.cast("date")
    if kind == "number":
        return _from_micros(_to_integer(value, source, kind))
    return value.cast("timestamp_ntz")


def _from_text(value: Column, target: str) -> Column:
    def guarded(pattern: str, type_name: str) -> Column:
        return F.when(value.rlike(pattern), value.try_cast(type_name))

    if target == "integer":
        return guarded(INTEGER_TEXT, "bigint")
    if target == "float":
        special = F.regexp_replace(F.lower(value), r"^\+|^-(?=nan)", "").try_cast("double")
        plain = value.rlike(FLOAT_TEXT)
        return F.when(plain, value.try_cast("double")).when(value.rlike(SPECIAL_FLOAT_TEXT), special)
    if target == "boolean":
        return F.when(value == "true", F.lit(True)).when(value == "false", F.lit(False))
    if target == "date":
        return guarded(DATE_TEXT, "date")
    return guarded(DATETIME_TEXT, "timestamp_ntz")


def _to_integer(value: Column, source: T.DataType, kind: str) -> Column:
    """Days for dates, microseconds for datetimes, truncation for fractions."""
    if kind == "date":
        return F.unix_date(value).cast("bigint")
    if kind == "datetime":
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(source, T.FloatType | T.DoubleType):
        inside = (value >= F.lit(-TWO_POW_63)) & (value < F.lit(TWO_POW_63))
        return F.when(inside, value.try_cast("bigint"))
    return value.try_cast("bigint")


def _from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")
