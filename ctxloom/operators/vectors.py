"""Exact vector search: dense, quantised, sparse and hybrid scores; fusion; batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.operators import nearest

INT8_MAX = 127.0
RRF_K = 60


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors score 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(doubles(a))


def truncated(a: Column, dims: int) -> Column:
    """The first dims components, at unit length."""
    return normalised(F.slice(a, 1, dims))


def int8_scale(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / INT8_MAX


def int8_codes(a: Column, scale: Column) -> Column:
    """Components as integers in -127..127."""
    return F.transform(a, lambda x: F.when(scale > 0, F.greatest(F.lit(-INT8_MAX), F.least(F.lit(INT8_MAX), F.round(x.cast("double") / scale)))).otherwise(0.0).cast("int"))


def int8_dot(a: Column, sa: Column, b: Column, sb: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return total.cast("double") * sa * sb


def score(kind: str, a: Column, b: Column) -> Column:
    """Larger is nearer: ip, l2 (1 - squared distance) or cosine."""
    return {"ip": dot, "l2": lambda x, y: 1 - l2_squared(x, y), "cosine": cosine}[kind](a, b)


def sparse_dot(a: Column, b: Column) -> Column:
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(F.transform(shared, lambda t: F.try_element_at(a, t) * F.try_element_at(b, t)), F.lit(0.0), lambda s, x: s + x)


def sparse_l2(a: Column, b: Column) -> Column:
    z = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    return F.aggregate(F.map_values(z), F.lit(0.0), lambda s, x: s + x * x)


def hybrid(dense: Column, sparse: Column, alpha: float = 0.5) -> Column:
    return dense * (1 - alpha) + sparse * alpha


def distance_to_score(kind: str, d: Column) -> Column:
    return -d if kind == "ip" else 1 / (1 + F.greatest(d, F.lit(0.0)))


def finite(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def one_query(rows: DataFrame, query: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows beside the one query vector (its own one-row frame, so a bounded broadcast)."""
    return rows.crossJoin(F.broadcast(query.select(F.col(vector).alias("query")).limit(1)))


def top(df: DataFrame, k: int, id_col: str = "vec_id", score_col: str = "score") -> DataFrame:
    """The k best rows; scores that are missing or not finite count as 0."""
    return df.withColumn(score_col, F.round(finite(F.col(score_col)), 6)).orderBy(F.desc(score_col), F.desc(id_col)).limit(k)


def batch_knn(rows: DataFrame, queries: DataFrame, k: int, kind: str = "ip", id_col: str = "vec_id", vector: str = "embedding", block_bytes: int = nearest.CELL_BYTES) -> DataFrame:
    """(query_id, rank, id, score) for a stated query set; ranks are limited before the shuffle."""
    scored = nearest.nearest(rows.select(id_col, vector), queries.select("query_id", "query"), k, kind, id_col, vector, cell_bytes=block_bytes)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(id_col)))).where(F.col("rank") <= k)


def rrf(a: DataFrame, b: DataFrame, id_col: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, rank)."""
    j = a.select(id_col, F.col("rank").alias("ra")).join(b.select(id_col, F.col("rank").alias("rb")), id_col, "full_outer")
    return j.select(id_col, (F.coalesce(1 / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("rb")), F.lit(0.0))).alias("score"))
