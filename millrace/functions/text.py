"""Text normalisation as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Remove white space at both ends: linear, unlike a regular expression."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def normalize(value: Column, operation: str) -> Column:
    match operation:
        case "trim":
            return strip(value)
        case "lowercase":
            return F.lower(value)
        case "uppercase":
            return F.upper(value)
        case "normalizeWhitespace":
            return F.regexp_replace(strip(value), r"(?U)\s+", " ")
    raise ValueError(operation)
