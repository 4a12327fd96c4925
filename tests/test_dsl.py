"""The filter language against golden id lists and against a plain evaluator on random trees."""

import random
import re

import pytest

from ctxloom.functions import uris
from ctxloom.operators import dsl
from ctxloom.operators.dsl import And, Eq, Or, PathScope, TimeRange
from pyspark.sql import functions as F


def ids(df, node, schema=dsl.DEFAULT):
    return {r.id for r in dsl.where(df, node, schema).select("id").collect()}


@pytest.fixture(scope="module")
def basic(spark):
    """Seven stations: id, platforms, kilometres from the first, name."""
    return spark.createDataFrame([(11, 3, 0.0, "quay"), (12, 7, 4.25, "mill lane"), (13, 7, 9.0, "north mill"), (14, 12, 17.75, "tower"), (15, 1, 21.0, "lower end"), (16, 16, 30.5, "quarry"), (17, 5, 44.0, "terminus")], "id int, n int, x double, s string").cache()


def test_scalar_ops(basic):
    assert ids(basic, {"op": "must", "field": "n", "conds": [7]}) == {12, 13}
    assert ids(basic, {"op": "range", "field": "n", "gt": 7}) == {14, 16}
    assert ids(basic, {"op": "prefix", "field": "s", "prefix": "qua"}) == {11, 16}
    assert ids(basic, {"op": "contains", "field": "s", "substring": "mill"}) == {12, 13}
    assert ids(basic, {"op": "range_out", "field": "n", "gte": 3, "lte": 12}) == {15, 16}
    assert ids(basic, {"op": "range_out", "field": "n", "gte": 12, "lte": 3}) == {15, 16}
    assert ids(basic, {"op": "range_out", "field": "n", "gt": 3, "lt": 12}) == {11, 14, 15, 16}
    assert ids(basic, {"op": "range", "field": "x", "center": [13.0], "radius": 5.0}) == {13, 14}
    assert ids(basic, {"op": "regex", "field": "s", "pattern": "(er|us)$"}) == {14, 17}
    assert ids(basic, {"op": "regex", "field": "s", "pattern": "(er"}) == set()
    assert ids(basic, {"op": "and", "conds": []}) == set() and len(ids(basic, None)) == 7


def test_paths(spark):
    paths = {21: "/zoo", 22: "/zoo/cats/lion.md", 23: "/zoo/cats/cubs/one.md", 24: "/zoo/birds/owl.md", 25: "/zoology/notes.md", 26: "zoo/map.md", 27: "park"}
    df = spark.createDataFrame(list(paths.items()), "id int, uri string")
    must = lambda p, **k: {"op": "must", "field": "uri", "conds": [p], **k}
    depth = lambda p: len([x for x in p.split("/") if x])
    inside = lambda p, root: ("/" + p.strip("/") + "/").startswith("/" + root.strip("/") + "/")
    for root in ("/zoo", "zoo", "/zoo/cats", "/none"):
        under = {k for k, p in paths.items() if inside(p, root)}
        assert ids(df, must(root)) == under
        for d in (0, 1, 2):
            assert ids(df, must(root, para=f"-d={d}")) == {k for k in under if depth(paths[k]) - depth(root) <= d}
        assert ids(df, {"op": "must_not", "field": "uri", "conds": [root]}) == set(paths) - under
    assert ids(df, must("/")) == set(paths) and ids(df, must("/", para="-d=1")) == {21, 27}
    assert ids(df, {"op": "prefix", "field": "uri", "prefix": "zoo"}) == {21, 22, 23, 24, 25}


def test_missing_values_have_two_valued_logic(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, None), (3, "b", [])], "id int, s string, search_tags array<string>")
    for f, v in (("s", "a"), ("search_tags", "x")):
        assert ids(df, {"op": "must", "field": f, "conds": [v]}) == {1} and ids(df, {"op": "must_not", "field": f, "conds": [v]}) == {2, 3}


def test_geo(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0), (3, 20.0, 15.0), (4, None, 1.0)], "id int, lon double, lat double")
    geo = lambda c, r: ids(df, {"op": "geo_range", "field": "geo", "center": c, "radius": r})
    assert geo("0,0", "100km") == {1} and geo("10,10", "2000km") == {1, 2, 3} and geo([10, 10], 0) == set()


def test_errors(basic):
    for node in ({"op": "range", "field": "n"}, {"op": "must", "field": "n", "conds": [1, "a"]}, {"op": "what"}, {"op": "regex", "field": "s", "pattern": "(?=a)"}, {"op": "must", "field": "uri", "conds": ["/"], "para": "x"}):
        with pytest.raises(dsl.FilterError):
            dsl.compile_node(node)


def test_lowering():
    assert dsl.lower(And((Or(()), Eq("n", 1)))) == {"op": "must", "field": "n", "conds": [1]}
    assert dsl.lower(Eq("uri", "/a")) == {"op": "must", "field": "uri", "conds": ["/a"], "para": "-d=0"}
    assert dsl.lower(TimeRange("t", "2024", None)) == {"op": "time_range", "field": "t", "gte": "2024"}
    assert dsl.lower(PathScope("uri", "/a", 2))["para"] == "-d=2" and dsl.lower(And(())) is None


def plain(node, row):
    """The same filter on one row, in plain Python; None for a node without predicate."""
    op = node.get("op")
    if op in ("and", "or"):
        parts = [plain(c, row) for c in node["conds"]]
        some = [p for p in parts if p is not None]
        if op == "and":
            return False if len(some) < len(parts) else all(some) if some else None
        return any(some) if some else None
    v = row[node["field"]]
    if op == "must":
        return v in node["conds"]
    if op == "must_not":
        return v not in node["conds"]
    if op == "range":
        return v is not None and node["gte"] <= v < node["lt"]
    if op == "contains":
        return v is not None and node["substring"] in v
    if op == "regex":
        return v is not None and re.search(node["pattern"], v) is not None
    return None


def test_random_trees(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *range(6)]), rng.choice([None, "ab", "bc", "abc", "c"])) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, n int, s string").cache()

    def tree(d):
        if d and rng.random() < 0.6:
            return {"op": rng.choice(["and", "or"]), "conds": [tree(d - 1) for _ in range(rng.randint(0, 3))]}
        return rng.choice([{"op": "must", "field": "n", "conds": [rng.randint(0, 5)]}, {"op": "must_not", "field": "s", "conds": ["ab", "c"]}, {"op": "range", "field": "n", "gte": 1, "lt": rng.randint(2, 6)}, {"op": "contains", "field": "s", "substring": "b"}, {"op": "regex", "field": "s", "pattern": "^a"}])

    trees = [tree(3) for _ in range(25)]
    cols = [F.coalesce(dsl.compile_node(t), F.lit(False)).alias(f"t{k}") if dsl.compile_node(t) is not None else F.lit(False).alias(f"t{k}") for k, t in enumerate(trees)]
    for r in df.select("id", "n", "s", *cols).collect():
        for k, t in enumerate(trees):
            assert r[f"t{k}"] == bool(plain(t, {"n": r.n, "s": r.s})), t


def test_count_and_sort(spark, basic):
    assert {(r.key, r.n) for r in dsl.count_rows(basic.withColumn("g", F.col("n") % 4), "g", {"op": "range", "field": "n", "gte": 5}, keep_zero=True).collect()} == {("3", 2), ("0", 2), ("1", 1)}
    assert [r.id for r in dsl.sort_rows(basic, "n", center=14, topk=2).collect()] == [14, 16]
    assert [r.id for r in dsl.sort_rows(basic, "x", topk=2).collect()] == [17, 16]


def test_uris(spark):
    df = spark.createDataFrame([("/a/b/c.md",), ("/",), ("x",)], "p string")
    assert [r.a for r in df.select(uris.ancestors(F.col("p")).alias("a")).collect()] == [["/a", "/a/b"], [], []]
    assert re.match(uris.glob_regex("/a/**/*.md"), "/a/b/c/d.md") and not re.match(uris.glob_regex("/a/*.md"), "/a/b/c.md") and re.match(uris.glob_regex("[!x]?"), "ab")
