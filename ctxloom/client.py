"""One object for a tree of context records: find, search, ls, tree, stat, grep, glob, read, link.

    c = Context(records, edges=edges, account="acct_1", roots=["/resources/src1"])
    c.find(vector, "/resources", limit=5, tags=["lang=en"], since="7d", now=now)

Every method but link() and stat() returns a lazy DataFrame over the records that the account may see; an account of None sees all.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.functions import uris
from ctxloom.operators import dsl, frontier, fsq, retrieve, vectors

EDGES = "src string, dst string, link_type string"


class Context:
    """records: uri, parent_uri, level, content, account_id, and embedding for vector search; further columns serve filters."""

    def __init__(self, records: DataFrame, edges: DataFrame | None = None, account: str | None = None, roots: list[str] | tuple = ("/",), kind: str = "cosine"):
        self.records = retrieve.visible(records, account, list(roots))
        self.edges = records.sparkSession.createDataFrame([], EDGES) if edges is None else edges
        self.roots, self.kind = list(roots), kind

    def _some(self, target: str, now: dt.datetime | None, **short) -> DataFrame:
        node = retrieve.shortcuts(now or dt.datetime(1970, 1, 1), **short)
        rows = self.records.where(uris.under(F.col("uri"), target))
        return rows if node is None else dsl.where(rows, node)

    def find(self, query: list[float], target: str = "/", limit: int = 10, threshold: float | None = None, inclusive: bool = False, now: dt.datetime | None = None, **short) -> DataFrame:
        """(uri, score): the best records by vector; shortcuts: level, context_type, tags, since, until, extra (a filter node)."""
        rows = self._some(target, now, **short)
        score = F.round(vectors.finite(vectors.score(self.kind, vectors.doubles(F.col("embedding")), F.array(*[F.lit(float(x)) for x in query]))), 6)
        ranked = rows.select("uri", F.xxhash64("uri").alias("doc_id"), score.alias("score"))
        return retrieve.find_quick(ranked, limit, threshold, inclusive).select("uri", "score")

    def search(self, queries: DataFrame, limit: int = 10, threshold: float = 0.0, **more) -> DataFrame:
        """(query_id, rank, uri, score, rounds): best-first search for queries (query_id, query) from this account's roots."""
        nodes = self.records.select("uri", "parent_uri", "level", vectors.doubles(F.col("embedding")).alias("embedding"))
        return frontier.find_thinking(nodes, queries, [uris.absolute(r) for r in self.roots], limit, threshold, kind=self.kind, **more)

    def ls(self, target: str = "/", recursive: bool = False, hidden: bool = False, limit: int = 1000) -> DataFrame:
        """(uri, is_dir): what lies in a directory."""
        files = self.records.select("uri", F.lit(False).alias("is_dir"))
        dirs = fsq.inferred_dirs(self.records).withColumn("is_dir", F.lit(True))
        every = files.unionByName(dirs).groupBy("uri").agg(F.max("is_dir").alias("is_dir"))
        return fsq.ls(every, target, recursive, hidden, limit)

    def tree(self, target: str = "/", level_limit: int = 3, node_limit: int | None = 1000) -> DataFrame:
        return fsq.tree(self.records, target, level_limit, node_limit)

    def stat(self, uri: str) -> dict:
        """Kind, number of records at or below, and letters of their contents."""
        rows = self.records.where(uris.under(F.col("uri"), uri))
        r = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("size"), F.coalesce(F.bool_or(F.col("uri") == uris.absolute(uri)), F.lit(False)).alias("own")).first()
        if not r.n:
            raise FileNotFoundError(uri)
        return {"uri": uris.absolute(uri), "is_dir": r.n > 1 or not r.own, "records": r.n, "size": r.size}

    def grep(self, pattern: str, target: str = "/", exclude: str | None = None, level_limit: int = -1, limit: int | None = None) -> DataFrame:
        return fsq.grep(self.records, pattern, target, exclude, level_limit, limit)

    def glob(self, pattern: str, limit: int | None = None) -> DataFrame:
        return fsq.glob(self.records, pattern, limit=limit).select("uri")

    def read(self, uri: str, offset: int = 0, limit: int = -1) -> DataFrame:
        """(uri, part): lines of one record."""
        return self.records.where(F.col("uri") == uris.absolute(uri)).select("uri", fsq.read_lines(F.col("content"), offset, limit).alias("part"))

    def link(self, source: str, *targets: str, link_type: str = "related_to") -> Context:
        """A context with further links; ends that aren't visible are an error."""
        ends = [uris.absolute(x) for x in (source, *targets)]
        seen = {r.uri for r in self.records.where(F.col("uri").isin(*ends)).select("uri").distinct().collect()}  # as many as are named
        if missing := [x for x in ends if x not in seen]:
            raise FileNotFoundError(", ".join(missing))
        new = self.records.sparkSession.createDataFrame([(ends[0], x, link_type) for x in ends[1:]], EDGES)
        out = Context.__new__(Context)
        out.__dict__ |= self.__dict__ | {"edges": self.edges.select("src", "dst", "link_type").unionByName(new).distinct()}
        return out

    def unlink(self, source: str, target: str) -> Context:
        out = Context.__new__(Context)
        gone = (F.col("src") == uris.absolute(source)) & (F.col("dst") == uris.absolute(target))
        out.__dict__ |= self.__dict__ | {"edges": self.edges.where(~gone)}
        return out

    def links(self, uri: str) -> DataFrame:
        """(uri, link_type, direction) of the visible records linked with one."""
        at = uris.absolute(uri)
        out = self.edges.where(F.col("src") == at).select(F.col("dst").alias("uri"), "link_type", F.lit("out").alias("direction"))
        back = self.edges.where(F.col("dst") == at).select(F.col("src").alias("uri"), "link_type", F.lit("in").alias("direction"))
        return out.unionByName(back).join(self.records.select("uri").distinct(), "uri", "left_semi")
