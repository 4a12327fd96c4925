"""Document processors that SQL cannot express: plain functions against hand-made results."""

import datetime as dt
import json

import pytest

from ctxloom.functions import documents as D
from ctxloom.functions import jsons
from ctxloom.functions import text as T
from ctxloom.operators import dsl, retrieve
from pyspark.sql import functions as F


def test_headings_skip_fences_comments_and_indents():
    t = "# A\n```\n# no\n```\n  # no\n\\# no\n<!-- # no\n# no -->\n## B ##\ntext"
    assert D.heading_lines(t) == [(1, 1, "A"), (9, 2, "B")] and D.heading_lines(None) == []


def test_chunks_lose_nothing_and_keep_the_limit():
    t = "\n\n".join(f"para {i} " + "word " * (i * 13 % 90) for i in range(60)) + "x" * 3000
    parts = D.split_text(t, 100, 25)
    assert "".join("".join(parts).split()) == "".join(t.split()) and all(D._tokens(p) <= 100 for p in parts)
    assert D.split_text("") == [] and D.split_text(None) == []


def test_sections_and_kinds():
    s = D.section_list("# A\nx\n# B\ny\n")
    assert len(s) == 1 and s[0][1] == 2 and s[0][0].startswith("A_1more_")
    kinds = {'{"a": 1}': "json", "<a><b/></a>": "xml", "a,b\n1,2": "csv", "a\tb\n1\t2": "tsv", "def f():\n  pass": "code", "a: 1\nb: 2": "yaml", "hello": "text", "": "empty", None: "empty"}
    assert {k: D.kind_of(k) for k in kinds} == kinds


def test_small_helpers():
    assert D.symbols("class A:\n def m(self): pass\n") == [("A", "class", 1), ("A.m", "function", 2)] and D.symbols("def (") == []
    assert D.apply_patch("a  b c", "a b", "X") == "X c" and D.apply_patch("abc", "z", "X") is None
    assert D.render_links("cat catalog cat", ["cat", "catalog"], ["u", "v"]) == "[cat](u) [catalog](v) cat"
    red, names = D.redact('token = "abcdef123456" and token: abcdef123456')
    assert "abcdef" not in red and list(names.values()) == ["abcdef123456"]
    assert json.loads(jsons.repair('```json\n{"a": [1, 2,],}\n```')) == {"a": [1, 2]} and jsons.repair("no") is None
    assert D.child_counts("<a><b/><b/><c/></a>") == [("b", 2), ("c", 1)] and D.child_counts("<") == []


def test_redact_restores(spark):
    df = spark.createDataFrame([("1", 'token = "abcdef123456" x'), ("2", "plain"), ("3", None)], "uri string, text string")
    assert {r.uri: r.text for r in D.restored(D.redacted(df)).collect()} == {"1": 'token = "abcdef123456" x', "2": "plain", "3": ""}


def test_search_times():
    now = dt.datetime(2024, 3, 1)
    assert retrieve.parse_time("7d", now) == dt.datetime(2024, 2, 23) and retrieve.parse_time("2024-01-02", now, upper=True).hour == 23
    with pytest.raises(dsl.FilterError):
        retrieve.shortcuts(now, since="1d", until="2d")
    assert retrieve.shortcuts(now) is None


def test_hotness_halves_in_a_week(spark):
    df = spark.createDataFrame([(3, dt.datetime(2024, 1, 8)), (3, dt.datetime(2024, 1, 1)), (3, None)], "n int, u timestamp_ntz")
    h = [r.h for r in df.select(retrieve.hotness(F.col("n"), F.col("u"), F.lit("2024-01-08").cast("timestamp_ntz")).alias("h")).collect()]
    assert abs(h[0] - 0.8) < 1e-9 and abs(h[1] - 0.4) < 1e-9 and h[2] == 0


def test_hierarchical_find_equals_closed_form(spark):
    nodes = spark.createDataFrame([("/a", None, True, 0.9), ("/b", None, True, 0.1), ("/a/x", "/a", True, 0.8), ("/a/y", "/a", True, 0.2), ("/a/x/1", "/a/x", False, 0.7), ("/a/y/1", "/a/y", False, 0.9), ("/b/1", "/b", False, 0.6)], "uri string, parent_uri string, is_dir boolean, score double")
    assert [(r.uri, r.hops) for r in retrieve.find_hierarchical(nodes, 5, 0.5).collect()] == [("/a/x/1", 2), ("/b/1", 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("漢字ab🙂",)], "t string")
    r = df.select(T.token_estimate(F.col("t")).alias("n"), T.markdown_tokens(F.col("t")).alias("m")).first()
    assert r.n == 6 and r.m == 2


def test_evidence_and_neighbours_by_plain_code(spark):
    from ctxloom.operators import fsq

    docs = ["the cat sat on the mat and then went home again", "a cathedral", "went home", "on the mat", "xcat sat on the mat and then went homey", "", None, "é ü naïve co-op"]
    items = ["cat", "the", "cat sat", "went home", "on the mat", "cat sat on the mat and then went home", "t on the mat an", "naïve", "zzz", "sat on the mat and then went home again"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {k: n for k, x in enumerate(items) if (n := sum(x in t for t in docs if t is not None))}
    assert {r.item_id: r.docs for r in fsq.evidence(d, i).collect()} == want
    assert fsq.evidence(d, i.limit(0)).count() == 0

    def lev(a, b):
        row = list(range(len(b) + 1))
        for k, x in enumerate(a):
            new = [k + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    got = {r.item_id: r.sim for r in fsq.neighbours(i).collect()}
    assert got == {k: round(1 - lev(a, b) / max(len(a), len(b)), 6) for k, (a, b) in enumerate(zip(items, items[1:]))}


def test_token_aware_chunks_and_packed_messages():
    from ctxloom.functions import documents as D

    text = "\u6f22\u5b57" * 400 + "\n\n" + "plain words here. " * 60
    parts = D.split_text(text, 100, 25)
    assert all(D._tokens(x) <= 100 for x in parts) and "".join("".join(parts).split()) == "".join(text.split())
    said = "One two. Three four! " + "long " * 40 + "end. Five? six"
    got = D.packed_sentences(said, 30)
    assert got[0] == "One two. Three four!" and got[-1] == "Five? six" and " ".join(got).split() == said.split()
    assert D.packed_sentences(None) == [] and D.packed_sentences("  ") == []


def test_bytes(spark):
    rows = [(b"a\0b", True), ("é text".encode(), False), (b"", False), (bytes([1, 2, 3, 65]), True), (bytes([1]) + b"text", False), (None, False), (b"x" * 5000 + b"\0", False)]
    df = spark.createDataFrame([(str(i), c) for i, (c, _) in enumerate(rows)], "uri string, content binary")
    assert [r.is_binary for r in D.sniffed(df).orderBy(F.col("uri").cast("int")).collect()] == [x for _, x in rows]
    texts = ["ééé", "a€b", "𝄞𝄞", "", None, "plain", "x�y"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "uri string, text string")
    for most in range(1, 9):
        got = [r.text for r in D.byte_limited(df, most).orderBy("uri").collect()]
        assert got == [(t or "").encode()[:most].decode(errors="ignore") for t in texts]
