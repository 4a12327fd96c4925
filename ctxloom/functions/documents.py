"""Document processors that need code a row at a time: Arrow batches in, rows out.

Each takes a frame with uri and text (content for bytes) and any further columns it names.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions import encodings, jsons, markup, outline, patching
from ctxloom.functions.registry import PARSER, find, names, register

MAX_TOKENS, MIN_TOKENS = 2048, 512
MESSAGE_CHARS = 100
#: Rows whose results are Python objects at once.
STEP_ROWS = 200


def _rows(df: DataFrame, schema: str, f: Callable[..., Iterable[tuple]]) -> DataFrame:
    columns = [x.strip().split(" ")[0] for x in re.split(r",(?![^<]*>)", schema)]

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), STEP_ROWS):  # what is handed back stays small, whatever a batch holds
                yield pd.DataFrame([x for r in pdf[lo: lo + STEP_ROWS].itertuples(index=False) for x in f(r)], columns=columns)

    return df.mapInPandas(run, schema)


_WIDE = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")


def _tokens(text: str) -> int:
    """0.7 for an East Asian letter, 0.3 for any other sign but white space, as text.markdown_tokens()."""
    wide = len(_WIDE.findall(text))
    return int(wide * 0.7 + (len(re.sub(r"\s", "", text)) - wide) * 0.3)


def _head(text: str, most: int) -> int:
    """Letters of the longest start of at most so many tokens, one letter at least."""
    lo, hi = 1, len(text)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if _tokens(text[:mid]) <= most else (lo, mid - 1)
    return lo


def heading_lines(text: str | None) -> list[tuple[int, int, str]]:
    """(line, level, title) of # headings outside code fences and comments; indented or escaped ones do not count."""
    out, fence, comment = [], None, False
    for i, line in enumerate((text or "").split("\n"), 1):
        m = re.match(r"^(```+|~~~+)", line)
        if m:
            fence = None if fence and line.startswith(fence) else fence or m[1]
            continue
        if fence:
            continue
        if comment or "<!--" in line:
            comment = "-->" not in line
            continue
        m = re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m:
            out.append((i, len(m[1]), m[2]))
    return out


def headings(df: DataFrame) -> DataFrame:
    return _rows(df, "uri string, line int, level int, title string", lambda r: [(r.uri, *x) for x in heading_lines(r.text)])


def split_text(text: str | None, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> list[str]:
    """Paragraphs packed to at most `most` tokens; longer ones are cut at sentences, then anywhere; a small last piece joins the one before if it fits."""
    out, held = [], ""
    for para in re.split(r"\n\s*\n", text or ""):
        units = [para] if _tokens(para) <= most else re.findall(r".+?(?:[.!?]\s+|$)", para, re.S)
        for u in units:
            while _tokens(u) > most:
                if held:
                    out.append(held)
                    held = ""
                cut = _head(u, most)
                out.append(u[:cut])
                u = u[cut:]
            join = held + ("\n\n" if held and u is para else "") + u
            if held and _tokens(join) > most:
                out.append(held)
                held = u
            else:
                held = join
    if held.strip():
        if out and _tokens(held) < least and _tokens(out[-1] + "\n\n" + held) <= most:
            out[-1] += "\n\n" + held
        else:
            out.append(held)
    return out


def chunks(df: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    return _rows(df, "uri string, chunk int, text string", lambda r: [(r.uri, i, x) for i, x in enumerate(split_text(r.text, most, most // 4))])


def packed_sentences(text: str | None, most: int = MESSAGE_CHARS) -> list[str]:
    """Sentences packed to at most `most` letters; a longer one stands alone."""
    out: list[str] = []
    for s in re.findall(r"\S.*?(?:[.!?\u3002\uff01\uff1f]+(?=\s|$)|[\u3002\uff01\uff1f]|\n|$)", text or "", re.S):
        s = s.strip()
        if not s:
            continue
        if out and len(out[-1]) + 1 + len(s) <= most:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def message_chunks(df: DataFrame, most: int = MESSAGE_CHARS) -> DataFrame:
    return _rows(df, "uri string, chunk int, text string", lambda r: [(r.uri, i, x) for i, x in enumerate(packed_sentences(r.text, most))])


def section_list(text: str | None, least: int = MIN_TOKENS) -> list[tuple[str, int, str]]:
    """(name, merged sections, text): small neighbours join; a joined one is named after its first."""
    lines = (text or "").split("\n")
    heads = heading_lines(text)
    marks = [(0, "intro")] + [(i - 1, t) for i, _, t in heads] + [(len(lines), "")]
    parts = [(t, "\n".join(lines[a:b])) for (a, t), (b, _) in zip(marks, marks[1:]) if "\n".join(lines[a:b]).strip()]
    out: list[list] = []
    for title, body in parts:
        if out and _tokens(out[-1][2]) < least and _tokens(out[-1][2] + body) <= MAX_TOKENS:
            out[-1][1] += 1
            out[-1][2] += "\n" + body
        else:
            out.append([title, 1, body])
    name = lambda t, n, b: (t if n == 1 else f"{t[:12]}_{n - 1}more_{hashlib.sha256(b.encode()).hexdigest()[:8]}")[:32]
    return [(name(*x), x[1], x[2]) for x in out]


def sections(df: DataFrame) -> DataFrame:
    return _rows(df, "uri string, name string, merged int, text string", lambda r: [(r.uri, *x) for x in section_list(r.text)])


def is_binary(content: Column) -> Column:
    """Whether bytes are no text: a zero, or over 30 % control signs, in the first 4,096."""
    head = F.decode(F.substring(F.coalesce(content, F.lit(b"")), 1, 4096), "ISO-8859-1")
    control = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0e-\x1f]", ""))
    return F.contains(head, F.lit("\0")) | (control / F.greatest(F.length(head), F.lit(1)) > 0.3)


def sniffed(df: DataFrame) -> DataFrame:
    return df.select("uri", is_binary(F.col("content")).alias("is_binary"))


def cut_bytes(text: Column, most: int) -> Column:
    """The longest start of a text of at most so many UTF-8 bytes: bytes are cut, then an unfinished letter at the end goes."""
    bytes_ = F.decode(F.substring(F.coalesce(text, F.lit("")).cast("binary"), 1, most), "ISO-8859-1")
    whole = F.regexp_replace(bytes_, r"(?:[\xC2-\xDF]|[\xE0-\xEF][\x80-\xBF]?|[\xF0-\xF4][\x80-\xBF]{0,2})$", "")
    return F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8")


def byte_limited(df: DataFrame, most: int) -> DataFrame:
    return df.select("uri", cut_bytes(F.col("text"), most).alias("text"))


def section_trees(df: DataFrame, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> DataFrame:
    """Leaves of each text's tree of sections (see outline)."""
    one = lambda r: [(r.uri, i, *x) for i, x in enumerate(outline.outline(r.text, heading_lines(r.text), _tokens, most, least))]
    return _rows(df, "uri string, leaf int, path string, level int, merged int, text string", one)


def kind_of(text: str | None) -> str:
    """json, xml, tsv, csv, code, yaml, text or empty."""
    t = (text or "").strip()
    if not t:
        return "empty"
    if t[0] in "{[":
        try:
            json.loads(t)
            return "json"
        except ValueError:
            pass
    if t[0] == "<":
        try:
            ElementTree.fromstring(t)
            return "xml"
        except ElementTree.ParseError:
            pass
    lines = t.split("\n")
    for sep, kind in (("\t", "tsv"), (",", "csv")):
        n = {x.count(sep) for x in lines[:50]}
        if len(lines) > 1 and len(n) == 1 and n != {0}:
            return kind
    if re.search(r"^\s*(def |class |import |function |public |#include)", t, re.M):
        return "code"
    if sum(bool(re.match(r"^[\w-]+:\s", x)) for x in lines) > len(lines) / 2:
        return "yaml"
    return "text"


def kinds(df: DataFrame) -> DataFrame:
    return _rows(df, "uri string, kind string", lambda r: [(r.uri, kind_of(r.text))])


def symbols(source: str | None) -> list[tuple[str, str, int]]:
    """(qualified name, kind, line) of Python definitions."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    out = []

    def walk(node, inside):
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.append((".".join([*inside, x.name]), "class" if isinstance(x, ast.ClassDef) else "function", x.lineno))
                walk(x, [*inside, x.name])

    walk(tree, [])
    return out


def code_symbols(df: DataFrame) -> DataFrame:
    return _rows(df, "uri string, name string, kind string, line int", lambda r: [(r.uri, *x) for x in symbols(r.text)])


def apply_patch(text: str | None, find: str, put: str) -> str | None:
    """Replace the first exact occurrence, else the first with any white space between the same words; None if there is none."""
    text = text or ""
    if find in text:
        return text.replace(find, put, 1)
    loose = r"\s+".join(map(re.escape, find.split()))
    m = re.search(loose, text) if loose else None
    return text[: m.start()] + put + text[m.end():] if m else None


def patched(df: DataFrame) -> DataFrame:
    return _rows(df, "uri string, text string, applied boolean", lambda r: [(r.uri, r.text if (x := apply_patch(r.text, r.find, r.put)) is None else x, x is not None)])


def patched_blocks(df: DataFrame) -> DataFrame:
    """Texts after their search-and-replace blocks, with the score of each block (see patching)."""

    def one(r):
        text, scores = patching.apply_blocks(r.text or "", [(b["search"], b["replace"]) for b in r.blocks])
        return [(r.uri, text, [round(s, 6) for s in scores])]

    return _rows(df, "uri string, text string, scores array<double>", one)


def render_links(text: str | None, spans, targets) -> str:
    """The first occurrence of each span at word bounds becomes a link; spans do not overlap."""
    text, taken = text or "", []
    for span, target in zip(spans, targets):
        for m in re.finditer(rf"(?<!\w){re.escape(span)}(?!\w)", text) if span.strip() else ():
            if not any(a < m.end() and m.start() < b for a, b, _ in taken):
                taken.append((m.start(), m.end(), f"[{span}]({target})"))
                break
    for a, b, new in sorted(taken, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def linked(df: DataFrame) -> DataFrame:
    return _rows(df, "uri string, text string", lambda r: [(r.uri, render_links(r.text, r.spans, r.targets))])


SECRET = re.compile(r"(?i)\b(?:token|api[_-]?key|password|secret)\s*[:=]\s*\"?([A-Za-z0-9_\-]{12,})")


def redact(text: str | None) -> tuple[str, dict[str, str]]:
    """Secret values as {{secret_k}}, with what each stands for."""
    found: dict[str, str] = {}

    def put(m):
        name = next((k for k, v in found.items() if v == m[1]), f"{{{{secret_{len(found)}}}}}")
        found[name] = m[1]
        return m[0].replace(m[1], name)

    return SECRET.sub(put, text or ""), found


def redacted(df: DataFrame) -> DataFrame:
    return _rows(df, "uri string, text string, secrets map<string,string>", lambda r: [(r.uri, *redact(r.text))])


def restored(df: DataFrame) -> DataFrame:
    out = F.aggregate(F.map_entries("secrets"), F.col("text"), lambda a, x: F.replace(a, x["key"], x["value"]))
    return df.select("uri", out.alias("text"))


def repaired(df: DataFrame) -> DataFrame:
    """JSON of each text, null where there is none (see jsons)."""
    return _rows(df, "uri string, json string", lambda r: [(r.uri, jsons.repair(r.text))])


def as_markdown(df: DataFrame) -> DataFrame:
    """Pages (uri, html) as markdown (see markup)."""
    return _rows(df, "uri string, text string", lambda r: [(r.uri, markup.markdown(r.html))])


def decoded(df: DataFrame) -> DataFrame:
    """Bytes (uri, content) as text, with the encoding they are in (see encodings); null for bytes that are no text."""
    return _rows(df, "uri string, encoding string, text string", lambda r: [(r.uri, *encodings.detect(r.content))])


@register(PARSER, "html", "htm", "xhtml")
def _html(text: str) -> str:
    return markup.markdown(text)


@register(PARSER, "json")
def _json(text: str) -> str:
    return jsons.repair(text) or ""


@register(PARSER, "md", "markdown", "txt", "log", "rst", "")
def _plain(text: str) -> str:
    return text


def parsed(files: DataFrame) -> DataFrame:
    """Files (path, content) as text: decoded, then through the parser registered for their suffix; other suffixes stay as they are.

    Bytes that are no text give null.
    """
    parsers = {n: find(PARSER, n) for n in names(PARSER)}  # those of the caller; a worker's own registry may be empty

    def one(r):
        encoding, text = encodings.detect(r.content)
        suffix = re.search(r"\.([A-Za-z0-9]+)$", r.path or "")
        name = suffix[1].lower() if suffix else ""
        return [(r.path, encoding, text if text is None or name not in parsers else parsers[name](text))]

    return _rows(files.select("path", "content"), "path string, encoding string, text string", one)


def child_counts(text: str | None) -> list[tuple[str, int]]:
    """Tags of the children of an XML document's root and how many there are, most first."""
    try:
        root = ElementTree.fromstring(text or "")
    except ElementTree.ParseError:
        return []
    return Counter(x.tag for x in root).most_common()


def xml_children(df: DataFrame) -> DataFrame:
    return _rows(df, "uri string, tag string, n int", lambda r: [(r.uri, *x) for x in child_counts(r.text)])


def sheet_markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a sheet as lines of a markdown table."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    parts = [cell(columns[0])]
    for c in columns[1:]:
        parts += [F.lit(" | "), cell(c)]
    return df.select(F.concat(F.lit("| "), *parts, F.lit(" |")).alias("line"))
