"""The one object over a small tree."""

import datetime as dt

import pytest

from ctxloom.client import Context

SCHEMA = "uri string, parent_uri string, level int, content string, account_id string, embedding array<float>, search_tags array<string>, updated_at timestamp_ntz"
AT = dt.datetime(2024, 1, 10)


@pytest.fixture
def context(spark):
    rows = [
        ("/r", "", 0, "root", "a", [0.5, 0.5], [], AT), ("/r/x", "/r", 1, "x", "a", [1.0, 0.0], [], AT), ("/r/x/1.md", "/r/x", 2, "alpha\nbeta\ngamma", "a", [1.0, 0.1], ["lang=en"], AT),
        ("/r/x/2.md", "/r/x", 2, "beta", "a", [0.0, 1.0], ["lang=de"], AT - dt.timedelta(days=9)), ("/r/y/.h.md", "/r/y", 2, None, "a", None, None, None), ("/r/x/3.md", "/r/x", 2, "hidden", "b", [1.0, 0.0], [], AT),
    ]
    return Context(spark.createDataFrame(rows, SCHEMA), account="a")


def test_paths(context):
    uris = lambda df: [r.uri for r in df.collect()]
    assert uris(context.ls("/r")) == ["/r/x", "/r/y"] and uris(context.ls("/r", recursive=True, hidden=True)) == ["/r/x", "/r/x/1.md", "/r/x/2.md", "/r/y", "/r/y/.h.md"]
    assert uris(context.glob("/r/**/*.md")) == ["/r/x/1.md", "/r/x/2.md", "/r/y/.h.md"] and "/r/x/1.md" in uris(context.tree("/r"))
    assert [(r.uri, r.line_no) for r in context.grep("^b", "/r").collect()] == [("/r/x/1.md", 2), ("/r/x/2.md", 1)]
    assert context.read("/r/x/1.md", 1, 1).first().part == "beta" and context.read("/r/x/3.md").collect() == []
    assert context.stat("/r/x") == {"uri": "/r/x", "is_dir": True, "records": 3, "size": 1 + 16 + 4} and context.stat("/r/x/2.md")["is_dir"] is False
    with pytest.raises(FileNotFoundError):
        context.stat("/r/x/3.md")


def test_vectors(spark, context):
    found = lambda **k: [r.uri for r in context.find([1.0, 0.0], now=AT, **k).collect()]
    assert found(limit=2) == ["/r/x", "/r/x/1.md"] and found(level=2, threshold=0.5) == ["/r/x/1.md"] and found(tags=["lang=de"]) == ["/r/x/2.md"]
    assert found(target="/r/x", since="7d", level=2) == ["/r/x/1.md"]
    asked = spark.createDataFrame([(7, [0.0, 1.0])], "query_id long, query array<double>")
    best = Context(context.records, roots=["/r"]).search(asked, 2, levels=(2,)).orderBy("rank").collect()
    assert [(r.query_id, r.uri) for r in best] == [(7, "/r/x/2.md"), (7, "/r/x/1.md")]


def test_links(context):
    linked = context.link("/r/x/1.md", "/r/x/2.md", "/r", link_type="cites")
    assert sorted((r.uri, r.direction) for r in linked.links("/r/x/1.md").collect()) == [("/r", "out"), ("/r/x/2.md", "out")]
    assert [(r.uri, r.link_type, r.direction) for r in linked.links("/r/x/2.md").collect()] == [("/r/x/1.md", "cites", "in")]
    assert linked.unlink("/r/x/1.md", "/r").links("/r").collect() == [] and context.links("/r").collect() == []
    with pytest.raises(FileNotFoundError, match="3.md"):
        context.link("/r/x/1.md", "/r/x/3.md")
