"""Paths and URIs as columns: scopes, parts, depth, globs, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "ctx://"


def encoded(uri: Column) -> Column:
    """ctx://a/b/ -> /a/b."""
    return F.concat(F.lit("/"), F.trim(F.regexp_replace(uri, "^" + SCHEME, ""), F.lit("/")))


def decoded(path: Column) -> Column:
    """/a/b -> ctx://a/b."""
    return F.concat(F.lit(SCHEME), F.trim(path, F.lit("/")))


def absolute(path: str) -> str:
    return "/" + path.strip("/")


def normalised(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def segments(path: Column) -> Column:
    """Non-empty parts of a path."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def depth(path: Column) -> Column:
    return F.size(segments(path))


def under(path: Column, root: str, levels: int = -1) -> Column:
    """The root itself (level 0) or a descendant down to so many levels (-1: any)."""
    root, p = absolute(root), normalised(path)
    if root == "/":
        inside, start = F.lit(True), 0
    else:
        inside, start = (p == root) | p.startswith(root + "/"), len(root.strip("/").split("/"))
    if levels >= 0:
        inside = inside & (depth(p) <= start + levels)
    elif root == "/":
        return path.isNotNull()
    return F.coalesce(inside, F.lit(False))


def ancestors(path: Column) -> Column:
    """Proper ancestors of a path, from the top: /a, /a/b for /a/b/c."""
    parts = segments(path)
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(F.array().cast("array<string>"))


def scope_roots(path: Column) -> Column:
    """A path's ancestors and itself."""
    return F.concat(ancestors(path), F.array(F.concat(F.lit("/"), F.array_join(segments(path), "/"))))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def leaf(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def relative(path: Column, root: str) -> Column:
    """The path below a root; '.' for the root itself."""
    root = absolute(root)
    return F.when(path == root, ".").when(path.startswith(root.rstrip("/") + "/"), path.substr(F.lit(len(root.rstrip("/")) + 2), F.length(path)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob: ** any depth, * and ? within a part, [..] classes."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and "]" in pattern[i + 2:]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1: end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
        else:
            out, i = out + (pattern[i] if pattern[i].isalnum() or pattern[i] in "/_" else "\\" + pattern[i]), i + 1
    return f"^{out}$"


def rewritten(path: Column, old: str, new: str) -> Column:
    """A path moved from one root to another; others stay."""
    old, new = absolute(old), absolute(new)
    return F.when(under(path, old), F.concat(F.lit(new), path.substr(F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def record_id(account: Column, uri: Column, level: Column) -> Column:
    """md5 of account and the uri of the level's own file."""
    seed = F.when(level == 0, F.concat(uri, F.lit("/.abstract.md"))).when(level == 1, F.concat(uri, F.lit("/.overview.md"))).otherwise(uri)
    return F.md5(F.concat(account, F.lit(":"), seed))


def with_level_suffix(uri: Column, level: Column) -> Column:
    return F.when(level == 0, F.concat(uri, F.lit("/.abstract.md"))).when(level == 1, F.concat(uri, F.lit("/.overview.md"))).otherwise(uri)
