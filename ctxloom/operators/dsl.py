"""The filter, sort and count expression language, compiled to Spark columns.

Accepted nodes (dicts):
  {"op": "and" | "or", "conds": [...], "ignore_empty_condition"?: bool}
  {"op": "must" | "must_not", "field": f, "conds": [...], "para"?: "-d=N"}
  {"op": "range" | "range_out" | "time_range", "field": f, "gte" | "gt": x, "lte" | "lt": y}, or "center": [c], "radius": r
  {"op": "geo_range", "field": f | [lon, lat], "center": "lon,lat" | [x, y], "radius": "10km" | "500m" | degrees}
  {"op": "prefix", "field": f, "prefix": s}, {"op": "contains", ..., "substring": s}, {"op": "regex", ..., "pattern": s}
  {"op": "label_in", "labels": [...]}

Predicates have two values: a missing value matches no positive predicate and every must_not.
A node without any predicate compiles to None; at the top that means no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions import uris

#: Metres of one degree, for planar distances.
METRES_PER_DEGREE = 111_320.0
MAX_DEPTH = 50


class FilterError(ValueError):
    """The expression is malformed."""


@dataclass(frozen=True)
class Schema:
    """Which fields are paths, lists, multi-valued strings, times; and the key field."""

    paths: frozenset = frozenset({"uri", "parent_uri"})
    lists: frozenset = frozenset({"search_tags"})
    multi: frozenset = frozenset()
    key: str = "id"
    geo: dict = field(default_factory=lambda: {"geo": ("lon", "lat")})


DEFAULT = Schema()


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(schema: Schema, name: str, test) -> Column:
    """test(value) for a scalar field, for any element of a list field."""
    if name in schema.lists:
        return _false(F.exists(F.col(name), test))
    if name in schema.multi:
        return _false(F.exists(F.split(F.col(name), ";"), test))
    return _false(test(F.col(name)))


def _depth(node: dict) -> int:
    m = re.fullmatch(r"\s*-d=(-?\d+)\s*", node.get("para", "-d=-1"))
    if not m:
        raise FilterError(f"bad para {node['para']!r}")
    return max(-1, min(MAX_DEPTH, int(m[1])))


def _must(node: dict, schema: Schema) -> Column | None:
    conds, name = list(node.get("conds", [])), node.get("field")
    if not name:
        raise FilterError("must needs a field")
    if not conds:
        return None
    if len({type(c) is str for c in conds}) > 1:
        raise FilterError("conds mix text and numbers")
    if name in schema.paths:
        return reduce(lambda a, b: a | b, (uris.under(F.col(name), str(c), _depth(node)) for c in conds))
    return _any(schema, name, lambda x: x.isin(conds))


def _bounds(node: dict, cast=lambda x: x) -> tuple:
    low = ("gte", node["gte"]) if node.get("gte") is not None else ("gt", node["gt"]) if node.get("gt") is not None else None
    high = ("lte", node["lte"]) if node.get("lte") is not None else ("lt", node["lt"]) if node.get("lt") is not None else None
    if node.get("center") is not None and "radius" in node:
        c = node["center"][0] if isinstance(node["center"], (list, tuple)) else node["center"]
        low, high = ("gte", c - node["radius"]), ("lte", c + node["radius"])
    if low is None and high is None:
        raise FilterError("a range needs a bound")
    return low and (low[0], cast(low[1])), high and (high[0], cast(high[1]))


def _range(node: dict, schema: Schema, cast=lambda x: x) -> Column:
    c = F.col(node["field"])
    low, high = _bounds(node, cast)
    parts = []
    if low:
        parts.append(c >= low[1] if low[0] == "gte" else c > low[1])
    if high:
        parts.append(c <= high[1] if high[0] == "lte" else c < high[1])
    return _false(reduce(lambda a, b: a & b, parts))


def _range_out(node: dict, schema: Schema) -> Column:
    """Outside the range with the same bounds; swapped bounds are put in order."""
    low, high = node.get("gte", node.get("gt")), node.get("lte", node.get("lt"))
    if low is not None and high is not None and low > high:
        node = dict(node)
        for a, b in (("gte", "lte"), ("gt", "lt")):
            node[a], node[b] = node.get(b), node.get(a)
    return F.col(node["field"]).isNotNull() & ~_range(node, schema)


def radius_degrees(radius: Any) -> float:
    if isinstance(radius, str):
        m = re.fullmatch(r"\s*([0-9.]+)\s*(km|m)?\s*", radius)
        if not m:
            raise FilterError(f"bad radius {radius!r}")
        return float(m[1]) * {"km": 1000.0, "m": 1.0, None: METRES_PER_DEGREE}[m[2]] / METRES_PER_DEGREE
    return float(radius)


def _geo(node: dict, schema: Schema) -> Column:
    """A circle in plain degrees; the box around it goes first, where statistics can prune."""
    x, y = (F.col(c) for c in (node["field"] if isinstance(node["field"], (list, tuple)) else schema.geo.get(node["field"], (f"{node['field']}_lon", f"{node['field']}_lat"))))
    cx, cy = (float(v) for v in (node["center"].split(",") if isinstance(node["center"], str) else node["center"]))
    r = radius_degrees(node["radius"])
    if r <= 0:
        return F.lit(False)
    return _false(x.between(cx - r, cx + r) & y.between(cy - r, cy + r) & (F.pow(x - cx, F.lit(2)) + F.pow(y - cy, F.lit(2)) <= r * r))


def _pattern(text: str) -> str | None:
    """A pattern of the subset that all engines read alike; None for a bad one."""
    if re.search(r"\(\?[=!<]|\\[1-9]", text):
        raise FilterError("look-around and back references are not supported")
    try:
        re.compile(text)
    except re.error:
        return None
    return text


def _logic(node: dict, schema: Schema) -> Column | None:
    parts = [compile_node(c, schema) for c in node.get("conds", [])]
    some = [p for p in parts if p is not None]
    if node["op"] == "and":
        if len(some) < len(parts) and not node.get("ignore_empty_condition"):
            return F.lit(False)
        return reduce(lambda a, b: a & b, some) if some else None
    return reduce(lambda a, b: a | b, some) if some else None


def _time(x: Any) -> Column:
    return F.lit(str(x)).cast("timestamp_ntz")


def compile_node(node: dict | Column | None, schema: Schema = DEFAULT) -> Column | None:
    """The predicate of a node, or None if it holds none."""
    if node is None or isinstance(node, Column):
        return node
    if not node:
        return None
    op = node.get("op")
    if op in ("and", "or"):
        return _logic(node, schema)
    if op == "must":
        return _must(node, schema)
    if op == "must_not":
        p = _must(node, schema)
        return None if p is None else ~p
    if op == "range":
        return _geo(node, schema) if isinstance(node.get("field"), (list, tuple)) else _range(node, schema)
    if op == "range_out":
        return _range_out(node, schema)
    if op == "time_range":
        return _range(node, schema, _time)
    if op == "geo_range":
        return _geo(node, schema)
    if op == "prefix":
        p = node["prefix"]
        if node["field"] in schema.paths and not p.startswith("/"):
            p = "/" + p
        return _any(schema, node["field"], lambda x: x.startswith(p))
    if op == "contains":
        return _any(schema, node["field"], lambda x: x.contains(node["substring"]))
    if op == "regex":
        p = _pattern(node["pattern"])
        return F.lit(False) if p is None else _any(schema, node["field"], lambda x: x.rlike(p))
    if op == "label_in":
        return _false(F.col(schema.key).isin(list(node["labels"])))
    raise FilterError(f"unknown op {op!r}")


def where(df: DataFrame, node: dict | None, schema: Schema = DEFAULT) -> DataFrame:
    """Rows that match; a filter without any predicate matches none, no filter matches all."""
    if node is None:
        return df
    p = compile_node(node, schema)
    return df.where(F.lit(False) if p is None else p)


# ---------------------------------------------------------------- typed expressions

@dataclass(frozen=True)
class Eq:
    field: str
    value: Any


@dataclass(frozen=True)
class In:
    field: str
    values: tuple


@dataclass(frozen=True)
class Range:
    field: str
    gte: Any = None
    gt: Any = None
    lte: Any = None
    lt: Any = None


@dataclass(frozen=True)
class Contains:
    field: str
    substring: str


@dataclass(frozen=True)
class TimeRange:
    """start <= field < end."""

    field: str
    start: Any = None
    end: Any = None


@dataclass(frozen=True)
class PathScope:
    field: str
    root: str
    depth: int = -1


@dataclass(frozen=True)
class Raw:
    node: dict


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


def lower(e: Any, schema: Schema = DEFAULT) -> dict | None:
    """The node of a typed expression; empty and single-part logic collapses."""
    if e is None or isinstance(e, dict):
        return e or None
    if isinstance(e, Raw):
        return e.node or None
    if isinstance(e, (And, Or)):
        parts = [x for x in (lower(p, schema) for p in e.parts) if x]
        return None if not parts else parts[0] if len(parts) == 1 else {"op": "and" if isinstance(e, And) else "or", "conds": parts}
    if isinstance(e, Eq):
        node = {"op": "must", "field": e.field, "conds": [e.value]}
        return node | {"para": "-d=0"} if e.field in schema.paths else node
    if isinstance(e, In):
        return {"op": "must", "field": e.field, "conds": list(e.values)}
    if isinstance(e, Range):
        return {"op": "range", "field": e.field, **{k: v for k in ("gte", "gt", "lte", "lt") if (v := getattr(e, k)) is not None}}
    if isinstance(e, Contains):
        return {"op": "contains", "field": e.field, "substring": e.substring}
    if isinstance(e, TimeRange):
        return {"op": "time_range", "field": e.field, **({"gte": e.start} if e.start is not None else {}), **({"lt": e.end} if e.end is not None else {})}
    if isinstance(e, PathScope):
        return {"op": "must", "field": e.field, "conds": [e.root], "para": f"-d={e.depth}"}
    raise FilterError(f"unknown expression {e!r}")


# ---------------------------------------------------------------- sorting and counting

def sort_rows(df: DataFrame, fields: str | Iterable[str], order: str | Iterable[str] = "desc", topk: int | None = None, center: float | None = None, tie: str | None = None, offset: int = 0) -> DataFrame:
    """Sort by one or more fields (descending by default), or by distance to a center (ties: the lower value first)."""
    fields = [fields] if isinstance(fields, str) else list(fields)
    order = [order] * len(fields) if isinstance(order, str) else list(order)
    if center is not None:
        keys = [F.abs(F.col(fields[0]) - center).asc(), F.col(fields[0]).asc()]
    else:
        keys = [F.col(f).desc_nulls_last() if o == "desc" else F.col(f).asc_nulls_last() for f, o in zip(fields, order)]
    out = df.orderBy(*keys, *([F.col(tie)] if tie else []))
    out = out.offset(offset) if offset else out
    return out if topk is None else out.limit(topk)


def count_rows(df: DataFrame, fields: str | Iterable[str] | None = None, node: dict | None = None, schema: Schema = DEFAULT, keep_zero: bool = False, having: dict | None = None, max_entry: int | None = None) -> DataFrame:
    """count, count by one field (list elements count each) or by two; keep_zero keeps keys that the filter empties."""
    fields = [] if fields is None else [fields] if isinstance(fields, str) else list(fields)
    if len(fields) > 2:
        raise FilterError("count takes two fields at most")
    rows = where(df, node, schema)
    if not fields:
        return rows.agg(F.count("*").alias("n"))
    values = lambda x: x.select(*[F.explode(f).alias(f) if f in schema.lists else F.col(f) for f in fields])
    key = F.concat_ws(",", *[F.col(f).cast("string") for f in fields])
    out = values(rows).groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    if keep_zero and len(fields) == 1:
        out = values(df).select(key.alias("key")).distinct().join(out, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    for op, x in (having or {}).items():
        out = out.where({"gt": F.col("n") > x, "gte": F.col("n") >= x, "lt": F.col("n") < x, "lte": F.col("n") <= x}[op])
    return out if max_entry is None else out.orderBy("key").limit(max_entry)
