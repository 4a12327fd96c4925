"""Retrieval over a directory tree: find, hierarchical find, hotness, scopes, distributions."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions import uris
from ctxloom.operators import dsl
from ctxloom.sources import scratch

HALF_LIFE_DAYS = 7.0


def hotness(count: Column, updated: Column, now: Column) -> Column:
    """(1 + n) / (2 + n), halved every week since the update; 0 without a date."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(updated.cast("timestamp"))) / 86400.0)
    return F.when(updated.isNull(), 0.0).otherwise((1.0 + count) / (2.0 + count) * F.exp(-math.log(2) / HALF_LIFE_DAYS * age))


def blended(score: Column, hot: Column, alpha: float) -> Column:
    return score * (1 - alpha) + hot * alpha


def propagated(score: Column, parent: Column, alpha: float) -> Column:
    """A parent score of exactly 0 leaves the score alone."""
    return F.when(parent != 0, score * alpha + parent * (1 - alpha)).otherwise(score)


def best_per(df: DataFrame, key: str, score: str = "score", tie: str | None = None) -> DataFrame:
    cols = df.columns
    order = F.struct(score, *([tie] if tie else []))
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select("r.*")


def find_quick(scored: DataFrame, limit: int, threshold: float | None = None, inclusive: bool = False) -> DataFrame:
    """scored (uri, doc_id, score): the best max(limit, 10) rows over the threshold, one per uri, then limit."""
    top = scored.orderBy(F.desc("score"), F.desc("doc_id")).limit(max(limit, 10))
    if threshold is not None:
        top = top.where(F.col("score") >= threshold if inclusive else F.col("score") > threshold)
    return best_per(top, "uri", tie="doc_id").orderBy(F.desc("score"), F.desc("doc_id")).limit(limit)


def children_top(df: DataFrame, n: int, parent: str = "parent_uri", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The n best children of each parent."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(F.desc(score), F.desc(tie)))).where(F.col("rank") <= n)


def find_hierarchical(nodes: DataFrame, limit: int, threshold: float = 0.0, alpha: float = 1.0) -> DataFrame:
    """(uri, score, hops): leaves reached from the roots over directories whose score passes.

    nodes: uri, parent_uri, is_dir, score. Level by level: the max(2 * limit, 20) best children of each
    directory on the frontier are kept, with the parent's score mixed in, and its directories that pass
    form the next frontier, down to the last level (paths must have no cycle). With no early stop this is the full best-first search. One join a level.
    """
    from pyspark.sql.types import DoubleType

    per = max(2 * limit, 20)
    frontier = nodes.where("is_dir and parent_uri is null").select("uri", F.lit(0.0).cast(DoubleType()).alias("mixed"))
    found, hop = None, 0
    while True:
        hop += 1
        kids = nodes.select("uri", "parent_uri", "is_dir", "score").join(frontier.select(F.col("uri").alias("parent_uri"), F.col("mixed").alias("parent_score")), "parent_uri")
        kids = kids.withColumn("mixed", propagated(F.col("score"), F.col("parent_score"), alpha)).where(F.col("mixed") > threshold)
        kids = kids.withColumn("rank", F.row_number().over(Window.partitionBy("parent_uri").orderBy(F.desc("mixed"), "uri"))).where(F.col("rank") <= per)
        kids = scratch.written(kids, "level")  # the next level starts from here
        leaves = kids.where("not is_dir").select("uri", F.col("mixed").alias("score"), F.lit(hop).alias("hops"))
        found = leaves if found is None else found.unionByName(leaves)
        frontier = kids.where("is_dir").select("uri", "mixed")
        if frontier.isEmpty():
            break
    return found.orderBy(F.desc("score"), "uri").limit(limit)


def visible(df: DataFrame, account: str | None, roots: list[str], path: str = "uri") -> DataFrame:
    """Rows of an account under its roots; account None is the administrator."""
    if account is None:
        return df
    inside = F.lit(False)
    for r in roots:
        inside = inside | uris.under(F.col(path), r)
    return df.where((F.col("account_id") == account) & inside)


def parse_time(text: str, now: dt.datetime, upper: bool = False) -> dt.datetime:
    """ISO time, a date (its end if an upper bound), or a span back from now: 90s, 30m, 12h, 7d, 2w."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", text)
    if m:
        return now - dt.timedelta(seconds=int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}[m[2]])
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()):
        day = dt.datetime.fromisoformat(text.strip())
        return day + dt.timedelta(days=1) - dt.timedelta(microseconds=1) if upper else day
    return dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00")).replace(tzinfo=None)


def shortcuts(now: dt.datetime, level=None, context_type=None, tags=None, since=None, until=None, time_field: str = "updated_at", extra: dict | None = None) -> dict | None:
    """A filter node from search shortcuts; an empty time span is an error."""
    parts = [extra] if extra else []
    if level is not None:
        parts.append({"op": "must", "field": "level", "conds": list(level) if isinstance(level, (list, tuple)) else [level]})
    if context_type:
        parts.append({"op": "must", "field": "context_type", "conds": [context_type]})
    for tag in tags or []:
        parts.append({"op": "must", "field": "search_tags", "conds": [tag.strip().lower()]})
    low = parse_time(since, now) if since else None
    high = parse_time(until, now, upper=True) if until else None
    if low and high and low > high:
        raise dsl.FilterError("since is after until")
    if low or high:
        parts.append({"op": "time_range", "field": time_field, **({"gte": low} if low else {}), **({"lte": high} if high else {})})
    return dsl.lower(dsl.And(tuple(parts)))


def distribution(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    s = F.col(score)
    return df.agg(F.count("*").alias("n"), F.round(F.min(s), 6).alias("low"), F.round(F.max(s), 6).alias("high"), F.round(F.avg(s), 6).alias("mean"), F.count_if(s > threshold).alias("above"))
