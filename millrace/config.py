"""Declarative configuration: every operator is a frozen dataclass.

Field metadata names the portable configuration key and its control kind, so one
function can check a plain dictionary before anything is read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping
from dataclasses import MISSING, field, fields
from typing import Any, TypeVar

from .errors import ConfigError

C = TypeVar("C")


def option(
    kind: str,
    *,
    key: str | None = None,
    default: Any = MISSING,
    choices: tuple[str, ...] = (),
    secret: bool = False,
) -> Any:
    """Declare a configuration field: text, number, boolean, select or json."""
    metadata = {"kind": kind, "key": key, "choices": choices, "secret": secret}
    if isinstance(default, list | dict):
        return field(default_factory=lambda: type(default)(default), metadata=metadata)
    return field(default=default, metadata=metadata, repr=not secret)


def build(cls: type[C], values: Mapping[str, Any], secrets: Mapping[str, str] | None = None) -> C:
    """Create `cls` from portable values; secrets come only from `secrets`."""
    given = {False: dict(values), True: dict(secrets or {})}
    options = {f.metadata["key"] or f.name: f for f in fields(cls) if "kind" in f.metadata}
    for secret, entries in given.items():
        foreign = {k for k in entries if k not in options or options[k].metadata["secret"] is not secret}
        if foreign:
            what = "secrets" if secret else "options"
            raise ConfigError(f"{cls.__name__} does not take these {what}: {', '.join(sorted(foreign))}.")
    chosen = {}
    for key, spec in options.items():
        value = given[spec.metadata["secret"]].get(key)
        if value is not None:
            check_value(spec.metadata["kind"], key, value, spec.metadata["choices"])
            chosen[spec.name] = value
        elif spec.default is spec.default_factory is MISSING:
            raise ConfigError(f"{cls.__name__} requires {key}.")
    return cls(**chosen)


def _is_number(value: Any) -> bool:
    return type(value) in (int, float)


def _is_json(value: Any) -> bool:
    try:
        json.dumps(value, allow_nan=False)
    except (TypeError, ValueError):
        return False
    return True


# Control kind -> what a value must pass, and how that is called.
KINDS: dict[str, tuple[Callable[[Any], bool], str]] = {
    "text": (lambda v: isinstance(v, str), "text"),
    "number": (_is_number, "a number"),
    "boolean": (lambda v: isinstance(v, bool), "true or false"),
    "json": (_is_json, "JSON-compatible"),
}


def check_value(kind: str, key: str, value: Any, choices: tuple[str, ...] = ()) -> None:
    listed = (lambda v: isinstance(v, str) and v in choices, f"one of: {', '.join(choices)}")
    passes, name = KINDS.get(kind, listed)
    if not passes(value):
        raise ConfigError(f"{key} must be {name}.")


def name_list(value: Any, key: str, *, at_least: int) -> tuple[str, ...]:
    """A list of unique, non-empty column names."""
    if not isinstance(value, list | tuple) or not all(isinstance(v, str) and v for v in value):
        raise ConfigError(f"{key} must list non-empty column names.")
    if len(value) < at_least:
        raise ConfigError(f"{key} must not be empty.")
    if len(set(value)) != len(value):
        raise ConfigError(f"{key} must be unique.")
    return tuple(value)


def column_name(value: Any) -> str:
    if not isinstance(value, str) or not value:
        raise ConfigError("column must be a non-empty name.")
    return value


def scalar(value: Any, key: str) -> str | int | float | bool:
    if not isinstance(value, str | int | float | bool):
        raise ConfigError(f"{key} must be text, a number or a boolean.")
    if isinstance(value, float) and not math.isfinite(value):
        raise ConfigError(f"{key} must be a finite number.")
    return value


def whole_number(value: Any, key: str, low: int, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value // 1:
        raise ConfigError(f"{key} must be an integer.")
    if value < low or (high is not None and value > high):
        bound = f"at least {low}" if high is None else f"between {low} and {high}"
        raise ConfigError(f"{key} must be {bound}.")
    return int(value)


def relative_path(value: Any, key: str = "sourcePath") -> str:
    """A safe location below an input root; directories and globs are allowed."""
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"{key} must be text.")
    parts = [p for p in value.split("/") if p not in ("", ".")]
    if value.startswith("/") or ":" in value.split("/")[0] or ".." in parts or not parts:
        raise ConfigError(f"{key} must be a safe relative location.")
    return "/".join(parts)


def under_root(root: str, path: str) -> str:
    return f"{root.rstrip('/')}/{path}"
