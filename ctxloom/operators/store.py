"""Keyed tables: upsert, merge, delete, expiry, replay of changes, paging, queues, packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions import uris


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: a map-side aggregate, no sort of the rows."""
    cols = df.columns
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("row")).select("row.*")


def known_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, record): the fields that a schema knows and a row has, as JSON; unknown columns and null values are left out."""
    known = [c for c in fields if c in df.columns]
    return df.select(key, F.to_json(F.struct(*known), {"ignoreNullFields": "true"}).alias("record"))


def fetch(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the keys, with found = false for keys that have none."""
    return keys.join(df.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def upsert(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return df.join(new.select(key), key, "left_anti").unionByName(new)


def merge(df: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Overlay non-null new fields on existing rows; keys that do not exist are left out (see unmatched)."""
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    out = df.join(n, key, "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])


def unmatched(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of an update that no row has: a strict update requires none."""
    return new.join(df.select(key), key, "left_anti").select(key)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(~F.coalesce(predicate, F.lit(False)))


def delete_subtree(df: DataFrame, root: str, path: str = "uri") -> DataFrame:
    return df.where(~uris.under(F.col(path), root))


def alive(df: DataFrame, now: Column, expires: str = "expire_at") -> DataFrame:
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The rows after a cursor in key order: a range filter that files' statistics prune, no offset."""
    rows = df if after is None else df.where(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def replay(base: DataFrame, changes: DataFrame, key: str, seq: str = "seq", kind: str = "kind") -> DataFrame:
    """Fold a change feed (kind UPSERT or DELETE) over a table: the last change of a key wins."""
    last = latest(changes, key, seq)
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col(kind) == "UPSERT").select(*base.columns))


def recover_stale(queue: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Messages in processing for longer than that go back to pending."""
    stale = (F.col("status") == "processing") & (F.col("since") < now - F.make_interval(secs=F.lit(seconds)))
    return queue.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


def head(queue: DataFrame) -> DataFrame:
    """The first pending message of each queue."""
    cols = queue.columns
    return queue.where("status = 'pending'").groupBy("queue_name").agg(F.min_by(F.struct(*cols), "message_id").alias("m")).select("m.*")


def pack_manifest(df: DataFrame, path: str = "uri", content: str = "content") -> DataFrame:
    return df.select(F.col(path).alias("path"), F.length(content).cast("long").alias("size"), F.sha2(F.col(content), 256).alias("sha256"))


def import_pack(have: DataFrame, pack: DataFrame, key: str, policy: str) -> DataFrame:
    """overwrite: the pack's rows win; skip: existing rows win; fail: raises if a key is in both."""
    if policy == "fail":
        if not have.join(pack.select(key), key, "left_semi").isEmpty():
            raise ValueError("rows exist already")
        policy = "skip"
    if policy == "overwrite":
        return upsert(have, pack, key)
    return have.unionByName(pack.join(have.select(key), key, "left_anti"))


def last_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
