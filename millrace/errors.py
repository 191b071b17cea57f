"""Errors raised by the library.

Messages name columns, steps and settings, never record values, so that they are
safe to log.
"""


class MillraceError(Exception):
    """Base class of all errors of the library."""


class ConfigError(MillraceError):
    """A configuration is wrong; raised before any data is read."""


class SchemaError(MillraceError):
    """A configuration does not fit the columns of its input."""


class DataError(MillraceError):
    """The data itself cannot be read or represented."""
