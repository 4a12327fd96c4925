"""A markdown text as a tree of sections, small ones merged from the bottom up.

A section is a heading with what follows it, down to the next heading of its level or above. Sections that are small with all that is in
them are leaves; small leaves that follow one another under one parent join as long as the result stays small, and are named after the
first. A section that is large becomes a folder: its own text first, then its parts. No line is lost or doubled.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

NAME = 32


@dataclass
class Section:
    title: str
    level: int
    own: str
    parts: list[Section] = field(default_factory=list)

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            s = todo.pop()
            if s.own:
                out.append(s.own)
            todo.extend(reversed(s.parts))
        return "\n".join(out)


def tree(text: str, headings: list[tuple[int, int, str]]) -> Section:
    """The root section of a text with headings (line, level, title)."""
    lines = text.split("\n")
    marks = [*headings, (len(lines) + 1, 0, "")]
    root = Section("", 0, "\n".join(lines[: marks[0][0] - 1]))
    open_ = [root]
    for (line, level, title), after in zip(marks, marks[1:]):
        while open_[-1].level >= level:
            open_.pop()
        one = Section(title, level, "\n".join(lines[line - 1: after[0] - 1]))
        open_[-1].parts.append(one)
        open_.append(one)
    return root


def _name(titles: list[str], body: str) -> str:
    """A file name: the first title, how many more, and a digest where it isn't the title alone."""
    plain = re.sub(r"[^\w-]+", "_", titles[0]).strip("_") or "section"
    if len(titles) == 1 and len(plain) <= NAME:
        return plain
    end = (f"_{len(titles) - 1}more" if len(titles) > 1 else "") + "_" + hashlib.sha256(body.encode()).hexdigest()[:8]
    return plain[: NAME - len(end)].strip("_") + end


def outline(text: str | None, headings: list[tuple[int, int, str]], tokens, most: int, least: int) -> list[tuple[str, int, int, str]]:
    """(path, level, merged, text) of the leaves in order. tokens counts; over `most` a section is a folder, under `least` it may join its neighbours."""
    if not text:
        return []
    root = tree(text, headings)
    out: list[tuple[str, int, int, str]] = []

    def leaves(section: Section, path: str) -> None:
        taken: dict[str, int] = {}

        def free(name: str) -> str:
            taken[name] = taken.get(name, 0) + 1
            return name if taken[name] == 1 else f"{name}_{taken[name]}"

        def emit(group: list[tuple[Section, str]]) -> None:
            if group:
                body = "\n".join(b for _, b in group)
                out.append((path + free(_name([s.title for s, _ in group], body)), group[0][0].level, len(group), body))

        own = Section(section.title or "intro", section.level, section.own)
        group: list[tuple[Section, str]] = [(own, own.own)] if own.own else []
        for part in section.parts:
            body = part.text()
            size = tokens(body)
            if size > most and part.parts:
                emit(group)
                group = []
                leaves(part, path + free(_name([part.title], body)) + "/")
                continue
            joined = "\n".join([*(b for _, b in group), body])
            if group and (tokens(group[-1][1]) >= least or size >= least or tokens(joined) > most):
                emit(group)
                group = []
            group.append((part, body))
        emit(group)

    whole = root.text()
    if tokens(whole) <= most:
        return [("document", 0, 1, whole)]
    leaves(root, "")
    return out
