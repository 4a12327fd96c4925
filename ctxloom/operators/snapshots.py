"""Snapshots of a table of files: commits, history, differences, restore.

A snapshot is a Merkle tree by directory. A file's digest is that of its content; a directory's is made from sums over its entries'
digests, one aggregate a level of depth, so a directory of any size is never gathered in one place. Three tables under one folder
hold everything: `blobs` (digest, content), `trees` (digest of a directory and its entries) and `commits` (with parents). A commit adds
only blobs and directories that are not there yet. A difference goes down from the roots and opens only directories whose
digests differ: its work follows the change, not the tree.

Paths are absolute and have no trailing slash. Null contents count as empty, null paths are left out; of rows with one path the one with the
greatest content counts. A path can't be a file and a directory at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ctxloom.functions import uris
from ctxloom.sources import scratch

TREES = "tree string, name string, oid string, is_dir boolean, n_files long"
BLOBS = "oid string, content string"
COMMITS = "commit string, parent string, root string, message string, author string, at timestamp_ntz, n_files long"
EMPTY = "empty"


@dataclass(frozen=True)
class Repo:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        schema = {"trees": TREES, "blobs": BLOBS, "commits": COMMITS}[name]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def add(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Append what is not there yet."""
        rows.join(self.table(name).select(*keys), keys, "left_anti").write.mode("append").parquet(f"{self.path}/{name}")


def _words(oid: Column) -> list[Column]:
    """The eight 32-bit words of a digest."""
    return [F.conv(F.substring(oid, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]


def merkle(files: DataFrame) -> DataFrame:
    """(tree, name, oid, is_dir, n_files, path) of every entry of every directory, from files (path, oid). The root's own entry has tree null."""
    files = files.select("path", "oid", uris.depth(F.col("path")).alias("depth"))
    levels = files.agg(F.max("depth")).first()[0] or 0
    below, out = None, None
    for depth in range(levels, 0, -1):
        here = files.where(F.col("depth") == depth).select("path", "oid", F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("n_files"))
        if below is not None:
            here = here.unionByName(below)
        here = here.withColumn("parent", uris.parent(F.col("path"))).withColumn("name", uris.leaf(F.col("path")))
        entry = F.sha2(F.concat_ws("\n", F.when(F.col("is_dir"), "d").otherwise("f"), "name", "oid"), 256)
        sums = here.withColumn("_w", F.array(*_words(entry))).groupBy("parent").agg(F.count("*").alias("n"), F.sum("n_files").alias("n_files"), *[F.sum(F.col("_w")[i]).alias(f"w{i}") for i in range(8)])
        dirs = sums.select("parent", F.sha2(F.concat_ws(",", "n", *[f"w{i}" for i in range(8)]), 256).alias("tree"), F.col("n_files").alias("total"))
        dirs = scratch.written(dirs, "directories")
        rows = here.join(dirs.select("parent", "tree"), "parent").select("tree", "name", "oid", "is_dir", "n_files", "path")
        out = rows if out is None else out.unionByName(rows)
        below = dirs.select(F.col("parent").alias("path"), F.col("tree").alias("oid"), F.lit(True).alias("is_dir"), F.col("total").alias("n_files"))
    if out is None:
        return files.sparkSession.createDataFrame([], TREES + ", path string")
    return out.unionByName(below.select(F.lit(None).cast("string").alias("tree"), F.lit("").alias("name"), "oid", "is_dir", "n_files", "path"))


def commit(repo: Repo, files: DataFrame, message: str, author: str, at: str, parent: str | None = None) -> str:
    """Record files (path, content); the id of the new commit."""
    one = files.where("path IS NOT NULL").groupBy("path").agg(F.max(F.coalesce("content", F.lit(""))).alias("content"))
    blobs = scratch.written(one.select("path", F.sha2("content", 256).alias("oid"), "content"), "blobs")
    repo.add("blobs", blobs.groupBy("oid").agg(F.any_value("content").alias("content")), ["oid"])
    name = _record(repo, blobs.select("path", "oid"), message, author, at, parent)
    scratch.drop(blobs)
    return name


def _record(repo: Repo, files: DataFrame, message: str, author: str, at: str, parent: str | None) -> str:
    tree = scratch.written(merkle(files), "merkle")
    repo.add("trees", tree.where("tree IS NOT NULL").select("tree", "name", "oid", "is_dir", "n_files").distinct(), ["tree", "name"])
    top = tree.where("tree IS NULL").first()
    root, n = (top.oid, top.n_files) if top else (EMPTY, 0)
    row = repo.spark.createDataFrame([(parent, root, message, author, at, n)], "parent string, root string, message string, author string, at string, n_files long")
    row = row.withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("commit", F.sha2(F.concat_ws("\n", F.coalesce("parent", F.lit("")), "root", "message", "author", F.col("at").cast("string")), 256))
    row = row.select("commit", "parent", "root", "message", "author", "at", "n_files")
    name = row.first().commit
    repo.add("commits", row, ["commit"])
    scratch.drop(tree)
    return name


def root_of(repo: Repo, name: str) -> str:
    row = repo.table("commits").where(F.col("commit") == name).first()
    if row is None:
        raise KeyError(f"no commit {name}")
    return row.root


def log(repo: Repo, head: str) -> DataFrame:
    """(age, commit, parent, message, author, at, n_files) from a commit back along its parents."""
    view = "ctxloom_commits_" + head[:16]
    repo.table("commits").createOrReplaceTempView(view)
    return repo.spark.sql(f"""WITH RECURSIVE line(age, commit, parent, message, author, at, n_files) MAX RECURSION LEVEL 100000 AS (
        SELECT 0L, commit, parent, message, author, at, n_files FROM {view} WHERE commit = :head
        UNION ALL SELECT age + 1, c.commit, c.parent, c.message, c.author, c.at, c.n_files FROM line JOIN {view} c ON c.commit = line.parent)
        SELECT * FROM line""", args={"head": head})


def diff(repo: Repo, old: str, new: str) -> DataFrame:
    """(path, old_oid, new_oid) of the files that differ between two commits."""
    spark, trees = repo.spark, repo.table("trees")
    level = spark.createDataFrame([("", root_of(repo, old), root_of(repo, new))], "path string, a string, b string").where("a <> b")
    found = spark.createDataFrame([], "path string, old_oid string, new_oid string")
    kept = []
    while not level.isEmpty():
        opened = trees.select("tree", "name", "oid", "is_dir")
        side = lambda c: level.where(F.col(c).isNotNull()).select("path", F.col(c).alias("tree")).join(opened, "tree").select("path", "name", F.struct("oid", "is_dir").alias(c))  # noqa: E731, B023
        both = side("a").join(side("b"), ["path", "name"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        file = lambda c: F.when(~F.col(f"{c}.is_dir"), F.col(f"{c}.oid"))
        folder = lambda c: F.when(F.col(f"{c}.is_dir"), F.col(f"{c}.oid"))
        both = scratch.written(both.select(F.concat("path", F.lit("/"), "name").alias("path"), file("a").alias("old_oid"), file("b").alias("new_oid"), folder("a").alias("a"), folder("b").alias("b")), "diff")
        found = found.unionByName(both.where("old_oid IS NOT NULL OR new_oid IS NOT NULL").select("path", "old_oid", "new_oid"))
        level = both.where("a IS NOT NULL OR b IS NOT NULL").select("path", "a", "b")
        kept.append(both)
    return found


def changes(repo: Repo, old: str, new: str) -> DataFrame:
    """(path, action) that lead from one commit to another: write or delete."""
    return diff(repo, old, new).select("path", F.when(F.col("new_oid").isNull(), "delete").otherwise("write").alias("action"))


def show(repo: Repo, name: str, folder: str = "/") -> DataFrame:
    """(path, oid) of the files of a commit, of one folder alone if asked."""
    spark, trees = repo.spark, repo.table("trees")
    at, tree = "", root_of(repo, name)
    for part in [x for x in folder.split("/") if x]:  # straight down to the folder
        row = trees.where((F.col("tree") == tree) & (F.col("name") == part)).first()
        if row is None:
            return spark.createDataFrame([], "path string, oid string")
        at += "/" + part
        if not row.is_dir:
            return spark.createDataFrame([(at, row.oid)], "path string, oid string")
        tree = row.oid
    level = spark.createDataFrame([(at, tree)], "path string, tree string")
    found = spark.createDataFrame([], "path string, oid string")
    while not level.isEmpty():
        here = scratch.written(level.join(trees.drop("n_files"), "tree").select(F.concat("path", F.lit("/"), "name").alias("path"), "oid", "is_dir"), "show")
        found = found.unionByName(here.where("NOT is_dir").select("path", "oid"))
        level = here.where("is_dir").select("path", F.col("oid").alias("tree"))
    return found


def contents(repo: Repo, files: DataFrame) -> DataFrame:
    """(path, content) of files (path, oid)."""
    return files.join(repo.table("blobs"), "oid").select("path", "content")


def restore(repo: Repo, head: str, source: str, message: str, author: str, at: str, folder: str = "/", dry_run: bool = False) -> tuple[str, DataFrame]:
    """(commit, changes): a new commit on head whose folder is as it was in source; head itself if nothing differs or on a dry run."""
    todo = diff(repo, head, source).where(uris.under(F.col("path"), folder))
    plan = todo.select("path", F.when(F.col("new_oid").isNull(), "delete").otherwise("write").alias("action"))
    if dry_run or todo.isEmpty():
        return head, plan
    kept = show(repo, head).join(todo.select("path"), "path", "left_anti")
    files = kept.unionByName(todo.where("new_oid IS NOT NULL").select("path", F.col("new_oid").alias("oid")))
    return _record(repo, files, message, author, at, head), plan
