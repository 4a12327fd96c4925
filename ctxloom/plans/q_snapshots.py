"""Snapshots of the context tree: two commits, what lies between them, and a restore."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.operators import snapshots as S
from ctxloom.plans.registry import query
from ctxloom.sources import scratch

FIRST = "SELECT uri AS path, coalesce(content, '') AS content FROM ctx WHERE doc_id % 3 <> 0"
SECOND = "SELECT uri AS path, CASE WHEN doc_id % 5 = 0 THEN coalesce(content, '') || '!' ELSE coalesce(content, '') END AS content FROM ctx WHERE doc_id % 4 <> 0"
VIEWS = f", a AS ({FIRST}), b AS ({SECOND})"


def _commits(t):
    repo = S.Repo(t.spark, scratch.new_path(t.spark, "repo"))
    files = t.ctx.select("doc_id", F.col("uri").alias("path"), F.coalesce("content", F.lit("")).alias("content"))
    one = S.commit(repo, files.where("doc_id % 3 <> 0").select("path", "content"), "first", "a", "2024-01-01 00:00:00")
    new = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    two = S.commit(repo, files.where("doc_id % 4 <> 0").select("path", new.alias("content")), "second", "b", "2024-01-02 00:00:00", one)
    return repo, one, two


@query("snapshot_log", VIEWS + " SELECT 0 AS age, 'second' AS message, (SELECT count(*) FROM b) AS n_files UNION ALL SELECT 1, 'first', (SELECT count(*) FROM a)")
def snapshot_log(t):
    repo, _, two = _commits(t)
    return S.log(repo, two).select("age", "message", "n_files")


@query("snapshot_changes", VIEWS + " SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'delete' ELSE 'write' END AS action FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.content <> b.content")
def snapshot_changes(t):
    repo, one, two = _commits(t)
    return S.changes(repo, one, two)


@query("snapshot_restore", VIEWS + " SELECT path, md5(content) AS md5 FROM a WHERE starts_with(path, '/resources/src1/') UNION ALL SELECT path, md5(content) FROM b WHERE NOT starts_with(path, '/resources/src1/')")
def snapshot_restore(t):
    """The second commit with /resources/src1 as it was in the first."""
    repo, one, two = _commits(t)
    three, _ = S.restore(repo, two, one, "back", "c", "2024-01-03 00:00:00", "/resources/src1")
    return S.contents(repo, S.show(repo, three)).select("path", F.md5("content").alias("md5"))
