"""Joins and folds that records, snapshots and link graphs need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions import uris
from ctxloom.functions.registry import MERGE, find, register


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges both of whose ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").dropDuplicates(["src", "dst", "link_type"])


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """What restoring new over old does to each key: write, delete or nothing."""
    j = old.select(key, F.col(value).alias("_o")).join(new.select(key, F.col(value).alias("_n")), key, "full_outer")
    return j.select(key, F.when(F.col("_n").isNull(), "delete").when(F.col("_o").isNull() | (F.col("_o") != F.col("_n")), "write").otherwise("unchanged").alias("action"))


def change_kinds(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    j = old.select(key, F.col(value).alias("_o")).join(new.select(key, F.col(value).alias("_n")), key, "full_outer")
    return j.select(key, F.when(F.col("_o").isNull(), "add").when(F.col("_n").isNull(), "delete").when(F.col("_o") != F.col("_n"), "update").otherwise("same").alias("kind"))


def merged_ranges(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Overlapping and adjacent ranges as one; a request's few ranges, so one window."""
    w = Window.orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(lo) <= reach + 1, 0).otherwise(1)).over(w)
    return df.withColumn("_i", island).groupBy("_i").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_i")


def under_roots(df: DataFrame, roots: DataFrame, path: str = "uri") -> DataFrame:
    """Rows with each root that they are at or below: an equi join on their own ancestors, no prefix join."""
    return df.withColumn("root", F.explode(uris.scope_roots(F.col(path)))).join(roots, "root")


def xor(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    j = a.distinct().select(key, F.lit(1).alias("_a")).join(b.distinct().select(key, F.lit(1).alias("_b")), key, "full_outer")
    return j.where(F.col("_a").isNull() | F.col("_b").isNull()).select(key)


def islands(df: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days of each key."""
    run = F.date_sub(day, F.row_number().over(Window.partitionBy(key).orderBy(day)))
    return df.withColumn("_run", run).groupBy(key, "_run").agg(F.min(day).alias("first_day"), F.count("*").alias("days")).drop("_run")


@register(MERGE, "sum")
def _sum(v: Column, seq: Column) -> Column:
    return F.sum(v)


@register(MERGE, "max")
def _max(v: Column, seq: Column) -> Column:
    return F.max(v)


@register(MERGE, "immutable")
def _immutable(v: Column, seq: Column) -> Column:
    """The first value."""
    return F.min_by(v, F.when(v.isNotNull(), seq))


@register(MERGE, "replace")
def _replace(v: Column, seq: Column) -> Column:
    """The last value that is not empty."""
    some = v.isNotNull() & (v.cast("string") != "")
    return F.max_by(F.when(some, v), F.when(some, seq))


def merge_expression(op: str, c: str, seq: str) -> Column:
    """The aggregate of a registered merge operation; patches fold in order instead (folds.merge_patch)."""
    return find(MERGE, op)(F.col(c), F.col(seq)).alias(c)


def merge(updates: DataFrame, key: str, seq: str, ops: dict[str, str]) -> DataFrame:
    """Fold updates of a record, field by field: sum, immutable (first), replace (last that is not empty), max."""
    return updates.groupBy(key).agg(*[merge_expression(op, c, seq) for c, op in ops.items()])


def merge_links(links: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return links.groupBy(*keys).agg(F.max("weight").alias("weight"), F.max_by("link_type", seq).alias("link_type"), F.min(seq).alias("created"))


def normalised_links(links: DataFrame) -> DataFrame:
    """Types are up to three snake-case words, else related_to; weights lie in 0..1, unreadable ones are 0.5."""
    kind = F.when(F.col("link_type").rlike(r"^[a-z]+(_[a-z]+){0,2}$"), F.col("link_type")).otherwise("related_to")
    w = F.col("weight").cast("string").try_cast("double")
    return links.withColumn("link_type", kind).withColumn("weight", F.when(w.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), w))))


def backlinks(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.collect_list("src").alias("sources"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def graph(nodes: DataFrame, edges: DataFrame, preview: int = 600) -> DataFrame:
    out = valid_edges(edges, nodes).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("links"))
    return nodes.select("id", F.substring("text", 1, preview).alias("preview")).join(out, "id", "left").select("id", "preview", F.coalesce("links", F.lit(0)).alias("links"))
