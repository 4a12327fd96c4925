"""HTML to markdown: a stack of open tags, the main block by text density, then blocks, lists, tables and links as markdown.

Pages need not be well formed: paragraphs, list items and table cells close one another, end tags without a start are ignored, and what is
open at the end is closed. The main block is the element whose own paragraphs hold the most text outside links; a paragraph counts
fully for its parent and half for the element around that. A page without paragraphs is taken whole.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Tag names by what they do.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "head", "svg", "iframe", "select", "button", "object"}
FURNITURE = {"nav", "footer", "aside", "form"}
PARAGRAPHS = {"p", "pre", "blockquote", "li", "td", "dd"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "figure", "figcaption", "address", "body", "html", "ul", "ol", "dl", "dt", "dd", "li", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "details", "summary"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}
#: A start tag of the key closes the innermost of these, unless one of the bounds is in between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_SPACE = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, tags: set[str], bounds: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in bounds:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._close({"p"}, {"table", "td", "th", "li", "blockquote", "div", "section", "article"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parsed(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _walk(root: Node):
    """Elements in document order, without silent ones; no recursion, so any depth goes."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in SILENT)


def _letters(root: Node) -> int:
    """Letters of the text that is in no link and no inner paragraph."""
    n, todo = 0, [root]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                n += len(_SPACE.sub("", c))
            elif c.tag not in SILENT and c.tag != "a" and c.tag not in PARAGRAPHS:
                todo.append(c)
    return n


def main_block(root: Node) -> Node:
    score: dict[Node, float] = {}
    for node in _walk(root):
        if node.attrs.get("id") == "js_content":  # a page that hides its content until a script runs
            return node
        above = node.parent
        if node.tag in PARAGRAPHS and above is not None:
            up, outside = above, False
            while up is not None and not outside:
                outside, up = up.tag in FURNITURE, up.parent
            n = 0 if outside else _letters(node)
            while above is not None and above.tag in PARAGRAPHS | {"ul", "ol", "table", "tbody", "thead", "tr", "dl"}:
                above = above.parent
            if n and above is not None:
                score[above] = score.get(above, 0) + n
                if above.parent is not None:
                    score[above.parent] = score.get(above.parent, 0) + n / 2
    best = max(score.values(), default=0)
    return next((n for n, s in score.items() if s == best), root)


def _inline(node: Node) -> str:
    """Text of a node as one run of markdown, line breaks as newlines."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(_SPACE.sub(" ", c))
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "img":
            src = c.attrs.get("src") or c.attrs.get("data-src") or ""
            out.append(f"![{c.attrs.get('alt', '')}]({src})" if src else "")
        elif c.tag in SILENT:
            continue
        else:
            inner = _inline(c)
            text = inner.strip()
            if text and c.tag in MARKS:
                inner = inner.replace(text, MARKS[c.tag] + text + MARKS[c.tag], 1)
            elif text and c.tag == "code":
                inner = inner.replace(text, f"`{text}`", 1)
            elif text and c.tag == "a" and c.attrs.get("href"):
                inner = inner.replace(text, f"[{text}]({c.attrs['href']})", 1)
            out.append(inner)
    return "".join(out)


def _tidy(text: str) -> str:
    lines = [re.sub(r" {2,}", " ", x).strip() for x in text.split("\n")]
    return "\n".join(lines).strip("\n")


def _raw(node: Node) -> str:
    return "".join(c if isinstance(c, str) else "\n" if c.tag == "br" else _raw(c) for c in node.children)


def _cells(row: Node) -> list[str]:
    return [" ".join(_tidy(_inline(c)).split()).replace("|", "\\|") for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]


def _table(node: Node) -> str:
    rows = [c for c in (_cells(r) for r in _walk(node) if r.tag == "tr") if c]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _list(node: Node) -> str:
    out, number = [], int(node.attrs["start"]) if node.attrs.get("start", "").isdigit() else 1
    for item in node.children:
        if not isinstance(item, Node) or item.tag in SILENT:
            continue
        body = "\n".join(_blocks(item))
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        out.append(mark + body.replace("\n", "\n" + " " * len(mark)))
    return "\n".join(out)


def _blocks(node: Node) -> list[str]:
    """Markdown blocks of a node's content; runs of text and inline tags between blocks are paragraphs."""
    out, run = [], Node("", {}, None)

    def flush() -> None:
        text = _tidy(_inline(run))
        if text:
            out.append(text)
        run.children = []

    for c in node.children:
        if isinstance(c, str):
            run.children.append(c)
        elif c.tag in SILENT:
            continue
        elif c.tag not in BLOCKS and not any(x.tag in BLOCKS for x in _walk(c)):
            run.children.append(c)
        else:
            flush()
            if c.tag[:1] == "h" and c.tag[1:].isdigit():
                text = " ".join(_tidy(_inline(c)).split())
                out += ["#" * int(c.tag[1]) + " " + text] if text else []
            elif c.tag == "hr":
                out.append("---")
            elif c.tag == "pre":
                out.append("```\n" + _raw(c).strip("\n") + "\n```")
            elif c.tag in ("ul", "ol"):
                out += [x for x in (_list(c),) if x]
            elif c.tag == "table":
                out += [x for x in (_table(c),) if x]
            elif c.tag == "blockquote":
                text = "\n\n".join(_blocks(c))
                out += ["\n".join("> " + x if x else ">" for x in text.split("\n"))] if text else []
            else:
                out += _blocks(c)
    flush()
    return out


def markdown(html: str | None, whole: bool = False) -> str:
    """The main block of a page as markdown (the whole page if asked)."""
    if not html:
        return ""
    root = parsed(html)
    return "\n\n".join(_blocks(root if whole else main_block(root)))
