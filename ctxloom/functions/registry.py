"""One place for what can be called by name: table functions (in SQL too), parsers by suffix, merge operations of fields."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

TABLE_FUNCTION, PARSER, MERGE = "table function", "parser", "merge"
_ENTRIES: dict[tuple[str, str], Any] = {}


def register(kind: str, *names: str) -> Callable[[Any], Any]:
    """Decorator: the object under each of the names; a name that is taken is an error."""

    def add(thing: Any) -> Any:
        for name in names:
            if (kind, name) in _ENTRIES and _ENTRIES[kind, name] is not thing:
                raise ValueError(f"{kind} {name!r} exists")
            _ENTRIES[kind, name] = thing
        return thing

    return add


def find(kind: str, name: str) -> Any:
    """The entry of that name; an unknown one is an error that says which there are."""
    try:
        return _ENTRIES[kind, name]
    except KeyError:
        raise KeyError(f"no {kind} {name!r}; there are {', '.join(names(kind)) or 'none'}") from None


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _ENTRIES if k == kind)


def install(spark: SparkSession) -> list[str]:
    """Make all table functions callable from SQL in this session."""
    from ctxloom.functions import tables  # noqa: F401  registers them

    for name in names(TABLE_FUNCTION):
        spark.udtf.register(name, find(TABLE_FUNCTION, name))
    return names(TABLE_FUNCTION)
