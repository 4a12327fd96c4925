"""Table functions for SQL: a text in, rows out, to be joined laterally.

    SELECT d.doc_id, h.* FROM documents d, LATERAL ctx_headings(d.text) h

Schemas come from analyze(), which also checks arguments before anything runs. A null text gives no rows. Each call sees one text; the
DataFrame forms in documents and fsq give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ctxloom.functions import documents as D
from ctxloom.functions.registry import TABLE_FUNCTION, register


def _text(arg: AnalyzeArgument, name: str) -> None:
    if arg.dataType.typeName() not in ("string", "void"):
        raise TypeError(f"{name} must be a string, not {arg.dataType.simpleString()}")


def _constant(arg: AnalyzeArgument | None, name: str, kind: type, default):
    if arg is None:
        return default
    if not arg.isConstantExpression or not isinstance(arg.value, kind):
        raise TypeError(f"{name} must be a constant {kind.__name__}")
    return arg.value


@register(TABLE_FUNCTION, "ctx_headings")
@udtf
class Headings:
    """(line, level, title) of the headings of a markdown text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text, "text")
        return AnalyzeResult(StructType().add("line", IntegerType()).add("level", IntegerType()).add("title", StringType()))

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from D.heading_lines(text)


@register(TABLE_FUNCTION, "ctx_chunks")
@udtf
class Chunks:
    """(chunk, text) pieces of a text of at most so many tokens."""

    @staticmethod
    def analyze(text: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(text, "text")
        if _constant(most, "most", int, 1) < 1:
            raise ValueError("most must be 1 or more")
        return AnalyzeResult(StructType().add("chunk", IntegerType()).add("text", StringType()))

    def eval(self, text: str | None, most: int = D.MAX_TOKENS) -> Iterator[tuple]:
        yield from enumerate(D.split_text(text, most, most // 4))


@register(TABLE_FUNCTION, "ctx_sections")
@udtf
class Sections:
    """(name, merged, text) sections of a markdown text."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        _text(text, "text")
        return AnalyzeResult(StructType().add("name", StringType()).add("merged", IntegerType()).add("text", StringType()))

    def eval(self, text: str | None) -> Iterator[tuple]:
        if text is not None:
            yield from D.section_list(text)


@register(TABLE_FUNCTION, "ctx_grep")
@udtf
class Grep:
    """(line_no, line) of the lines that match a constant pattern, which is compiled once."""

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        _text(text, "text")
        re.compile(_constant(pattern, "pattern", str, ""))
        return AnalyzeResult(StructType().add("line_no", IntegerType()).add("line", StringType()))

    def __init__(self, *_: object) -> None:
        self.pattern: re.Pattern | None = None

    def eval(self, text: str | None, pattern: str) -> Iterator[tuple]:
        if self.pattern is None:
            self.pattern = re.compile(pattern)
        for number, line in enumerate((text or "").split("\n"), 1):
            if self.pattern.search(line):
                yield number, line
