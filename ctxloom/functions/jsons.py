"""JSON out of damaged text, in one pass with a stack.

What is read: text around the value, fences, comments, single or curly quotes, keys and words without quotes, missing or
surplus commas, missing colons, quotes inside strings, line breaks in strings, closers that are missing or of the wrong kind,
Python's literals, a text that ends anywhere. A quote ends a string only where what follows can follow a string. What is left is dropped.
"""

from __future__ import annotations

import json
import re

# Quotes and what closes them; words that stand for values.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
LITERALS = {"true": True, "false": False, "null": None, "none": None, "nan": None, "undefined": None, "infinity": None}

_NUMBER = re.compile(r"[-+]?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])")
_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)+", re.S)
_AFTER = re.compile(r"""\s*(?:[,:}\]]|//|/\*|\Z)|\s+["'“‘`][^"'“”‘’`\n]*["'”’`]\s*[:,}\]]""")
_AFTER_KEY = re.compile(r"""\s*(?:[,:}\]=]|[-\d"'“‘\[{]|true|false|null|None|//|/\*|\Z)""")
_NEXT_PAIR = re.compile(r"""\s*,\s*(?:["'“‘`][^"'”’`]*["'”’`]|\w+)\s*:""")
_NEXT_KEY = re.compile(r"\s*\n\s*[\"'“‘`\w]")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_MISSING = object()


def _string(s: str, i: int, after: re.Pattern = _AFTER) -> tuple[str, int]:
    """The string that starts with the quote at i, and where it ends."""
    close, out, i = QUOTES[s[i]], [], i + 1
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s):
            n = s[i + 1]
            if n == "u" and re.match(r"[0-9a-fA-F]{4}", s[i + 2: i + 6]):
                pair = re.match(r"\\u(d[89ab][0-9a-f]{2})\\u(d[c-f][0-9a-f]{2})", s[i: i + 12], re.I)
                if pair:
                    out.append(chr(0x10000 + ((int(pair[1], 16) & 0x3FF) << 10) + (int(pair[2], 16) & 0x3FF)))
                    i += 12
                else:
                    code = int(s[i + 2: i + 6], 16)
                    out.append("�" if 0xD800 <= code < 0xE000 else chr(code))
                    i += 6
                continue
            out.append(_ESCAPES.get(n, n))
            i += 2
            continue
        if c == close and (after.match(s, i + 1) or _NEXT_KEY.match(s, i + 1)):
            return "".join(out), i + 1
        out.append(c)
        i += 1
    return "".join(out), i


def _bare(s: str, i: int, stop: str) -> tuple[str, int]:
    """Text without quotes up to one of the stops."""
    j = i
    while j < len(s) and s[j] not in stop:
        j += 1
    return s[i:j].strip(), j


def _scalar(s: str, i: int):
    """(value, end) of a string, number, literal or bare text at i."""
    if s[i] in QUOTES:
        return _string(s, i)
    m = _NUMBER.match(s, i)
    if m:
        text = m[0].lstrip("+")
        return (float(text) if re.search(r"[.eE]", text) else int(text)), m.end()
    text, j = _bare(s, i, ",}]\n{[")
    return (LITERALS[text.lower()] if text.lower() in LITERALS else text), j


def repaired(text: str | None):
    """The value in the text, _MISSING if there is no object, array or lone value of JSON."""
    s = text or ""
    try:
        return json.loads(s, parse_constant=lambda _: None)
    except (ValueError, RecursionError):
        pass
    first = re.search(r"[{\[]", s)
    if not first:
        return _MISSING
    i, n = first.start(), len(s)
    stack: list[list] = []  # [container, key that waits for its value]
    while True:
        if i < n and s[i] in "{[":
            value = {} if s[i] == "{" else []
            if stack:
                _put(stack[-1], value)
            stack.append([value, _MISSING])
            i += 1
        top = stack[-1]
        m = _SKIP.match(s, i)
        i = m.end() if m else i
        if i >= n:
            break
        c = s[i]
        if c in "}]":
            kind = dict if c == "}" else list
            # a closer of the wrong kind closes up to its own kind, if there is one, else the innermost
            if not isinstance(top[0], kind) and _NEXT_PAIR.match(s, i + 1) and any(isinstance(x[0], dict) for x in stack[:-1]):
                kind = type(top[0])  # what follows belongs to the object around it
            depth = next((k for k in range(len(stack) - 1, -1, -1) if isinstance(stack[k][0], kind)), len(stack) - 1)
            for _ in range(len(stack) - depth):
                last = stack.pop()
                if last[1] is not _MISSING:
                    last[0].setdefault(last[1], None)
                root = last[0]
            i += 1
            if not stack:
                return root
        elif c in ",:":
            if c == "," and top[1] is not _MISSING:
                top[0].setdefault(top[1], None)
                top[1] = _MISSING
            i += 1
        elif c in "{[":
            if isinstance(top[0], dict) and top[1] is _MISSING:
                top[1] = ""
            continue
        elif isinstance(top[0], dict) and top[1] is _MISSING:
            if c in QUOTES:
                top[1], i = _string(s, i, _AFTER_KEY)
            else:
                top[1], j = _bare(s, i, ":,}]\n=")
                i = j + (j < n and s[j] == "=") if j > i else i + 1
        else:
            value, j = _scalar(s, i)
            _put(top, value)
            i = max(j, i + 1)
    while stack:
        last = stack.pop()
        if last[1] is not _MISSING:
            last[0].setdefault(last[1], None)
        root = last[0]
    return root


def _put(top: list, value) -> None:
    if isinstance(top[0], list):
        top[0].append(value)
    else:
        top[0]["" if top[1] is _MISSING else top[1]] = value
        top[1] = _MISSING


def repair(text: str | None) -> str | None:
    """The value as strict JSON with sorted keys; null if there is none."""
    value = repaired(text)
    return None if value is _MISSING else json.dumps(value, sort_keys=True)
