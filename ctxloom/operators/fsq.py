"""File-system style queries over a path column."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.functions import uris

#: Bytes of texts that are searched for at once.
SHARD_BYTES = 8 << 20


def ls(df: DataFrame, root: str, recursive: bool = False, hidden: bool = False, limit: int = 1000, path: str = "uri") -> DataFrame:
    rows = df.where(uris.under(F.col(path), root, -1 if recursive else 1) & (F.col(path) != uris.absolute(root)))
    if not hidden:
        rows = rows.where(~uris.leaf(F.col(path)).startswith("."))
    return rows.orderBy(path).limit(limit)


def inferred_dirs(df: DataFrame, path: str = "uri") -> DataFrame:
    return df.select(F.explode(uris.ancestors(F.col(path))).alias("uri")).distinct()


def tree(df: DataFrame, root: str, level_limit: int = 3, node_limit: int | None = 1000, hidden: bool = False, path: str = "uri") -> DataFrame:
    """(uri, is_dir, depth) below a root, depth first, directories before files of a level."""
    inside = df.where(uris.under(F.col(path), root)).select(F.col(path).alias("uri"))
    if not hidden:
        inside = inside.where(~uris.leaf(F.col("uri")).startswith("."))
    nodes = inside.select("uri", F.lit(False).alias("is_dir")).unionByName(inferred_dirs(inside, "uri").withColumn("is_dir", F.lit(True)))
    base = len([x for x in root.split("/") if x])
    nodes = nodes.where(uris.under(F.col("uri"), root) & (F.col("uri") != uris.absolute(root))).withColumn("depth", uris.depth(F.col("uri")) - base).where(F.col("depth") <= level_limit)
    parts = uris.segments(F.col("uri"))
    # a file sorts after the directories beside it
    key = F.transform(parts, lambda x, i: F.concat(F.when((i == F.size(parts) - 1) & ~F.col("is_dir"), "1").otherwise("0"), x))
    nodes = nodes.orderBy(key)
    return nodes if node_limit is None else nodes.limit(node_limit)


def glob(df: DataFrame, pattern: str, path: str = "uri", limit: int | None = None) -> DataFrame:
    fixed = pattern.split("*")[0].split("?")[0].split("[")[0]
    rows = df.where(F.col(path).startswith(fixed) & F.col(path).rlike(uris.glob_regex(pattern)))  # the fixed start reaches the scan
    return rows if limit is None else rows.orderBy(path).limit(limit)


def grep(df: DataFrame, pattern: str, root: str = "/", exclude: str | None = None, level_limit: int = -1, limit: int | None = None, path: str = "uri", content: str = "content") -> DataFrame:
    """(uri, line_no, line) of matching lines; texts without any match are never split."""
    rows = df.where(uris.under(F.col(path), root, level_limit))
    if exclude:
        rows = rows.where(~uris.under(F.col(path), exclude))
    if not re.search(r"\\[AGZz]|\(\?[!=<]", pattern):  # such parts look beyond a line
        rows = rows.where(F.col(content).rlike("(?m)" + pattern))
    lines = rows.select(F.col(path).alias("uri"), F.posexplode(F.split(content, "\n", -1)).alias("at", "line"))
    out = lines.where(F.col("line").rlike(pattern)).select("uri", (F.col("at") + 1).alias("line_no"), "line")
    return out if limit is None else out.orderBy("uri", "line_no").limit(limit)


def read_lines(content: Column, offset: int, limit: int) -> Column:
    """limit lines from line offset (from 0); a negative limit reads to the end."""
    rows = F.split(content, "\n", -1)
    return F.array_join(F.slice(rows, offset + 1, F.size(rows) if limit < 0 else F.lit(limit)), "\n")


def search_text(df: DataFrame, needle: str, around: int, content: str = "content") -> DataFrame:
    at = F.instr(F.lower(content), needle.lower())
    return df.withColumn("at", at).where("at > 0").withColumn("around", F.substr(F.col(content), F.greatest(F.lit(1), F.col("at") - around), F.lit(len(needle) + 2 * around)))


def written(old: Column, new: Column, mode: Column) -> Column:
    """replace, append, or create, which conflicts with content that is there."""
    return F.when(mode == "replace", new).when(mode == "append", F.concat(F.coalesce(old, F.lit("")), new)).when(old.isNull(), new).otherwise("conflict")


def neighbours(items: DataFrame) -> DataFrame:
    """Similarity of each item to the next."""
    a = items.select("item_id", F.col("text").alias("a"))
    b = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b"))
    return a.join(b, "item_id").select("item_id", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("sim"))


def reply_f1(m: DataFrame) -> DataFrame:
    """Word overlap of each turn with the next one of its conversation."""
    w = m.select("conv_id", "turn", F.array_distinct(T.answer_words(F.coalesce("text", F.lit("")))).alias("w"))
    j = w.join(w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v")), ["conv_id", "turn"])
    n = F.size("w") + F.size("v")
    return j.select("conv_id", "turn", F.round(F.when(n == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect("w", "v")) / n), 6).alias("f1"))


def evidence(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, docs): how many documents contain each item's whole text, for items that any contains.

    The items' texts are dealt into shards of a checked size. A task searches its documents for all texts of a shard at once, with one
    automaton, and hands in a count a text: the documents are read once a shard and never shuffled. Null texts match nothing, an
    empty item is in every text.
    """
    texts = items.where("text IS NOT NULL").select("text").distinct()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    shards = -(-size // shard_bytes)
    found = None
    for k in range(shards):
        some = sorted(r.text for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == k).collect())  # about shard_bytes
        part = docs.where("text IS NOT NULL").select("text").mapInArrow(_searched(some), "text string, docs long").groupBy("text").agg(F.sum("docs").alias("docs"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return items.select("item_id", F.lit(0).cast("long").alias("docs")).limit(0)
    return items.select("item_id", "text").join(found, "text").groupBy("item_id").agg(F.sum("docs").alias("docs"))


def _searched(texts: list[str]):
    """Counts, for the texts of a task's batches, how many contain each of some texts."""

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in texts:
            if t:
                automaton.add_word(t, t)
        if len(automaton):
            automaton.make_automaton()
        counts: Counter = Counter()
        for batch in batches:
            if "" in texts:
                counts[""] += batch.num_rows
            if len(automaton):
                for lo in range(0, batch.num_rows, 100):
                    for text in batch.column(0).slice(lo, 100).to_pylist():
                        counts.update({t for _, t in automaton.iter(text)})
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["text", "docs"])

    return run
