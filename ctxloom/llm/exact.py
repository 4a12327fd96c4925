"""Exact duplicates: a minimal perfect hash over the distinct digests of a history, looked up by what comes later.

The texts' SHA-256 digests are the keys. Each shard of the key space holds a few thousand digests and is one row of the
index table: the bit vectors of a cascade of hash levels (a key lives in the first level where no other key has its
place; its slot is the rank of its bit), and by slot the full digest, the locator of the row that stays, and the number of
rows. Any digest leads to some slot, so a lookup compares all 32 bytes kept there: equal bytes join the slot's group,
others are no members and are grouped by themselves.

Shuffled are ids and digests, never texts, and only distinct digests of each task go to a shard, so a group of copies of
any size is one row there. The number of shards follows the number of rows.

Defined results: null texts are empty texts. Texts are equal when they are the same after lower-casing A-Z. Of equal texts the row
with the largest doc_id stays (null ids last; of rows with one id, exactly one, by a row number drawn at the scan). Other
columns of the table are carried by without_repeats() whatever their names, and not read by groups(). An empty table gives no rows.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import _base

#: Rows a shard stands for.
SHARD_ROWS = 4096
#: Places per key in a level, and the number of levels; keys still in conflict then are kept in order beside them.
SPARE = 2
LEVELS = 32
DIGEST = 32

INDEX = "shard long, n long, levels array<binary>, rest binary, digests binary, keep_id array<long>, keep_row array<long>, n_rows array<long>"
GROUPS = "digest binary, keep_id long, keep_row long, group_size long, in_history boolean"


# ---------------------------------------------------------------- the hash of one shard

def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    words = np.ascontiguousarray(digests[:, :16]).view(np.uint64)
    with np.errstate(over="ignore"):
        return (_base.mix(words[:, 0] + words[:, 1] * np.uint64(2 * level + 1)) % np.uint64(size)).astype(np.int64)


def _ordered(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view(f"S{DIGEST}").ravel() if len(digests) else np.zeros(0, f"S{DIGEST}")


def build(digests: np.ndarray) -> tuple[list[bytes], bytes, np.ndarray]:
    """(levels, rest, slot of each digest) for an (n, 32) array of distinct digests; the slots are 0 to n - 1."""
    slots, left, levels, used = np.full(len(digests), -1, np.int64), np.arange(len(digests)), [], 0
    while len(left) and len(levels) < LEVELS:
        size = -(-SPARE * len(left) // 8) * 8
        at = _places(digests[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        slots[left[mine]] = used + np.cumsum(alone)[at[mine]] - 1
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        used += int(alone.sum())
        left = left[~mine]
    by = sorted(range(len(left)), key=lambda k: digests[left[k]].tobytes())
    left = left[by]
    slots[left] = used + np.arange(len(left))
    return levels, digests[left].tobytes(), slots


def slots_of(levels: list[bytes], rest: bytes, digests: np.ndarray) -> np.ndarray:
    """A slot for each digest, right for members; -1 where no level has one."""
    out, left, used = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for k, packed in enumerate(levels):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")
        at = _places(digests[left], k, len(bits))
        hit = bits[at] == 1
        out[left[hit]] = used + np.cumsum(bits, dtype=np.int64)[at[hit]] - 1
        used += int(bits.sum())
        left = left[~hit]
    if rest and len(left):
        place = {rest[i: i + DIGEST]: used + i // DIGEST for i in range(0, len(rest), DIGEST)}
        out[left] = [place.get(digests[i].tobytes(), -1) for i in left]
    return out


def _bytes(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, DIGEST)


def _longs(values, nulls=None) -> pa.Array:
    return pa.array(values, pa.int64(), mask=nulls)


def _index_shard(rows: pa.Table) -> pa.Table:
    digests = _bytes(rows.column("digest"))
    levels, rest, slots = build(digests)
    by = np.argsort(slots)
    row = {"shard": rows.column("shard")[0].as_py(), "n": len(by), "levels": levels, "rest": rest, "digests": digests[by].tobytes()}
    row |= {c: rows.column(c).take(pa.array(by)).to_pylist() for c in ("keep_id", "keep_row", "n_rows")}
    kinds = [("shard", pa.int64()), ("n", pa.int64()), ("levels", pa.list_(pa.binary())), ("rest", pa.binary()), ("digests", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("keep_id", "keep_row", "n_rows"))]
    return pa.Table.from_pylist([row], schema=pa.schema(kinds))


def _look_up(new: pa.Table, index: pa.Table) -> pa.Table:
    """All groups of a shard: those of the index with what came to them, then those of digests that it has not."""
    digests = _bytes(new.column("digest"))
    shard = index.to_pylist()[0] if index.num_rows else {"levels": [], "rest": b"", "digests": b"", "keep_id": [], "keep_row": [], "n_rows": []}
    held = np.frombuffer(shard["digests"], np.uint8).reshape(-1, DIGEST)
    slot = slots_of(shard["levels"], shard["rest"], digests)
    member = slot >= 0
    member[member] = (held[slot[member]] == digests[member]).all(axis=1)  # the bytes decide
    ids, keep_rows, counts = (new.column(c).to_pylist() for c in ("keep_id", "keep_row", "n_rows"))
    keep = list(zip(shard["keep_id"], shard["keep_row"], strict=True))
    size = list(shard["n_rows"])
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    for k in np.flatnonzero(member).tolist():
        s = int(slot[k])
        keep[s] = max(keep[s], (ids[k], keep_rows[k]), key=order)
        size[s] += counts[k]
    apart = np.flatnonzero(~member).tolist()
    keep += [(ids[k], keep_rows[k]) for k in apart]
    size += [counts[k] for k in apart]
    return pa.table({
        "digest": pa.array([x.tobytes() for x in held] + [digests[k].tobytes() for k in apart], pa.binary()), "keep_id": _longs([x[0] for x in keep]), "keep_row": _longs([x[1] for x in keep]),
        "group_size": _longs(size), "in_history": pa.array([True] * len(held) + [False] * len(apart), pa.bool_()),
    })


# ---------------------------------------------------------------- tables

def digest_of(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256))


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    """A row per digest: its shard, the row that stays so far, the number of rows."""
    one = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("n_rows"))
    return one.select(F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"), "digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "n_rows")


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """The index over rows (doc_id, row, digest): a row per shard that has any."""
    return _base.keep(_distinct(rows, shards).groupBy("shard").applyInArrow(_index_shard, INDEX), "exact-index")


def look_up(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """All groups after rows (doc_id, row, digest) came to those of the index."""
    return _distinct(rows, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_look_up, GROUPS)


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, index) of written rows (doc_id, row, digest, historical)."""
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    index = build_index(rows.where("historical"), shards)
    return look_up(index, rows.where("NOT historical"), shards), index


def groups(docs: DataFrame, historical: Column) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256, in_history (whether the index has its text).

    historical: which documents the index is built over; the others are looked up in it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest_of(F.col("text")).alias("digest"), F.coalesce(historical, F.lit(False)).alias("historical"))
    rows = _base.keep(rows, "exact-rows")
    found, index = _grouped(rows)
    found = _base.keep(found, "exact-groups")
    _base.forget(index)
    joined = _base.moved(rows).join(_base.moved(found), "digest")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "in_history")


def without_repeats(docs: DataFrame, historical: Column) -> DataFrame:
    """The documents that stay, with all their columns."""
    row, digest, flag = _base.private(docs, "row", "digest", "historical")
    held = _base.keep(docs.select("*", F.monotonically_increasing_id().alias(row), digest_of(F.col("text")).alias(digest), F.coalesce(historical, F.lit(False)).alias(flag)), "exact-docs")
    found, _ = _grouped(held.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(digest).alias("digest"), F.col(flag).alias("historical")))
    stay = found.select(F.col("keep_row").alias(row))
    return held.join(_base.moved(stay), row, "left_semi").select(*docs.columns)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id has an even checksum are the history; the others are looked up."""
    docs = _base.table(spark, sf_dir, "documents")
    return groups(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0).drop("in_history")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
