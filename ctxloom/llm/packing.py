"""Packing into optimal length buckets.

Documents become sequences of at most max_len tokens (a longer one is cut into consecutive chunks, so
no token is lost). One histogram of sequence lengths over the whole table goes to the driver: it has
at most max_len rows however large the table. Dynamic programming over it picks the bucket limits
that minimise padding. Inside a bucket, sequences in (doc_id, chunk) order form batches of
floor(token_budget / limit) sequences; a batch number needs the count of all earlier sequences of the
bucket, which is a prefix sum over per-partition counts, so no bucket meets in one task.

Null or empty texts have no tokens: they are sequences of length 0 in the first bucket. Null ids come
first; repeated rows are sequences of their own; an empty table gives no rows. Ties: sequences of one id and chunk are ordered by
length, and equal ones may change places. Texts of any length are counted whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm import _base as B

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 16_384


def best_limits(counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket limits (ascending lengths, the last one the largest length present) of least padding.

    counts[n]: sequences of length n. cost(i, j]: padding of lengths i+1..j padded to j. A layer of the
    dynamic program takes each best split over all i at once.
    """
    present = np.flatnonzero(counts)
    if not len(present):
        return []
    n = np.cumsum(counts[present].astype(np.int64))
    total = np.cumsum(counts[present].astype(np.int64) * present)
    n, total = np.concatenate([[0], n]), np.concatenate([[0], total])
    m, k = len(present), min(buckets, len(present))
    best = np.full((k + 1, m + 1), np.iinfo(np.int64).max // 4)
    best[0, 0] = 0
    split = np.zeros((k + 1, m + 1), np.int64)
    for b in range(1, k + 1):
        for j in range(1, m + 1):
            cost = best[b - 1, :j] + present[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])
            split[b, j] = int(np.argmin(cost))
            best[b, j] = cost[split[b, j]]
    limits, j = [], m
    for b in range(int(np.argmin(best[1:, m])) + 1, 0, -1):
        limits.append(int(present[j - 1]))
        j = int(split[b, j])
    return limits[::-1]


def sequences(docs: DataFrame, n_tokens, max_len: int = MAX_LEN, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, chunk, start, length): every token of every document in exactly one sequence."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(n_tokens.cast("long"), F.lit(0)).alias("n"))
    t = t.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / max_len)))))
    return t.select("doc_id", F.col("chunk").cast("int").alias("chunk"), (F.col("chunk") * max_len).alias("start"), F.least(F.col("n") - F.col("chunk") * max_len, F.lit(max_len)).cast("int").alias("length"))


def pack(seqs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Adds bucket, padded_len, batch (within the bucket) and slot to sequences."""
    if token_budget < max_len:
        raise ValueError("a batch must hold the longest sequence")
    # one shuffle: ordered by id, so each partition is a stretch of every bucket's order
    seqs = B.keep(seqs.repartitionByRange("doc_id", "chunk").withColumn("part", F.spark_partition_id()), "sequences")
    per_part = B.keep(seqs.groupBy("part", "length").count(), "lengths")
    counts = np.zeros(max_len + 1, np.int64)
    for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most max_len + 1 rows
        counts[r["length"]] = r["n"]
    limits = best_limits(counts, buckets)
    if not limits:
        return seqs.select("doc_id", "chunk", "start", "length", F.lit(0).alias("bucket"), F.lit(0).alias("padded_len"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"))

    def in_bucket(df: DataFrame) -> DataFrame:
        bucket = F.lit(len(limits) - 1)
        for b in range(len(limits) - 2, -1, -1):
            bucket = F.when(F.col("length") <= limits[b], F.lit(b)).otherwise(bucket)
        return df.withColumn("bucket", bucket)

    # a row per partition and bucket
    before = in_bucket(per_part).groupBy("part", "bucket").agg(F.sum("count").alias("n"))
    before = before.select("part", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    t = in_bucket(seqs).join(before, ["part", "bucket"])
    at = F.row_number().over(Window.partitionBy("part", "bucket").orderBy("doc_id", "chunk", "length")) - 1 + F.col("before")
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.col("bucket") + 1)
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(limit, F.lit(1)))).cast("long")
    t = t.withColumn("at", at).withColumn("padded_len", limit).withColumn("per_batch", per_batch)
    return t.select("doc_id", "chunk", "start", "length", "bucket", "padded_len", F.floor(F.col("at") / F.col("per_batch")).cast("long").alias("batch"), (F.col("at") % F.col("per_batch")).cast("int").alias("slot"))


def n_words(text):
    """Tokens of a text here: its words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents")
    return pack(sequences(docs, n_words(F.col("text"))))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every kept document's sequences with their places; only ids and lengths move. Columns but doc_id and text are not read."""
    key = B.row_key(F.col("doc_id"), F.col("text"))
    seqs = docs.select(F.struct("doc_id", key.alias("key")).alias("doc_id"), n_words(F.col("text")).alias("n"))
    placed = pack(sequences(seqs, F.col("n")))
    return placed.select(F.col("doc_id.doc_id").alias("doc_id"), "chunk", "start", "length", "bucket", "padded_len", "batch", "slot")
