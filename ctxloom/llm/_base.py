"""Shared helpers of the training-data operators: shared folders, Arrow text batches, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step inside a task handles at a time; bounds a worker's memory.
SLICE_BYTES = 2_000_000
U64 = np.uint64


# ---------------------------------------------------------------- shared folder

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir; in local mode alone, a temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark, "_ctxloom_shared", None) or "file://" + tempfile.mkdtemp(prefix="ctxloom-")
        spark._ctxloom_shared = at
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ctxloom-{name}-{uuid.uuid4().hex}"


#: Shuffle files of a written table are not read again, and go when it is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, share: int = 1) -> DataFrame:
    """Write a frame to the shared folder and read it again: cuts lineage and survives lost executors.

    share: a table known to be so many times smaller than the corpus is written by as many times fewer tasks.
    """
    spark = df.sparkSession
    if share > 1:
        df = df.coalesce(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))) // share)
    at = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._ctxloom_path = at
    return out


def moved(df: DataFrame) -> DataFrame:
    """A frame that grows with the corpus, to be joined by a shuffle (which splits hot keys) in a small run too: one plan at every size."""
    return df.hint("merge")


def forget(df: DataFrame) -> None:
    """Delete what keep() wrote, once nothing reads it any more."""
    at = getattr(df, "_ctxloom_path", None)
    if at:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def private(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """Rows whose labels no model may see: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def row_key(doc_id, text):
    """Key of a row even where ids repeat or are null: rows of one key are exact repeats."""
    return F.xxhash64(doc_id, text)


# ---------------------------------------------------------------- Arrow batches

def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch so that each piece holds about `limit` bytes of text (one longer text stands alone)."""
    col = batch.column(column)
    if batch.num_rows == 0:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int32 if col.type == pa.string() else np.int64)[col.offset: col.offset + len(col) + 1]
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    if col.null_count:
        col = col.fill_null("")
    if col.type != pa.string():
        col = col.cast(pa.string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]: off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and first word index of each text (n + 1)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[off] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?'\"()[]{}<>*#%$&|-_")] = True


def lower_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """text_bytes() in lower case, letters beyond ASCII too."""
    raw, off = text_bytes(col)
    if (raw > 127).any():
        raw, off = text_bytes(pc.utf8_lower(col.fill_null("")))
    return _LOWER[raw], off


def edges_off(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the ASCII punctuation at their edges, however much there is; a span of nothing else gets empty."""
    plain = np.flatnonzero(~_EDGE[raw])
    if not len(plain):
        return starts, starts
    a, b = np.searchsorted(plain, starts), np.searchsorted(plain, ends)
    some = b > a
    return np.where(some, plain[np.minimum(a, len(plain) - 1)], starts), np.where(some, plain[np.maximum(b - 1, 0)] + 1, starts)


# ---------------------------------------------------------------- hashing

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = (np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
_POW: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.empty(max(n, 1 << 16), U64)
            have[0] = 1
            have[1:] = base
            np.multiply.accumulate(have, out=have)
        if n <= 4 * SLICE_BYTES:
            _POW[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


#: Values that one polynomial covers. Sequences of 1,024 and more can be made that differ and agree under every base.
_CHUNK = 128


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] (uint64) for each span, equal wherever the spans' values are equal.

    Short spans: a polynomial modulo 2**64 and a finaliser. Longer ones: the same over the hashes of their chunks, counted from the span's start.
    """
    n = len(values)
    acc = np.zeros(n + 1, U64)
    np.cumsum(values * _powers(_BASE, n), out=acc[1:])
    inverse = _powers(_INV, n + 1)

    def plain(a, b):
        return mix((acc[b] - acc[a]) * inverse[a] + (b - a).astype(U64))

    size = ends - starts
    out = plain(starts, ends)
    long = np.flatnonzero(size > _CHUNK)
    if len(long):
        chunks = -(-size[long] // _CHUNK)
        first = np.cumsum(chunks) - chunks
        lo = np.repeat(starts[long], chunks) + (np.arange(int(chunks.sum())) - np.repeat(first, chunks)) * _CHUNK
        parts = plain(lo, np.minimum(lo + _CHUNK, np.repeat(ends[long], chunks)))
        out[long] = mix(span_hashes(parts, first, first + chunks) + size[long].astype(U64))
    return out


#: Bytes whose words are hashed together.
HASHED = 1 << 15


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes() of words in order, some of them at a time, so that their bytes stay in the processor's cache."""
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        lo = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, lo + HASHED, side="right")))
        out[at:end] = span_hashes(_BYTE[raw[lo: ends[end - 1]]], starts[at:end] - lo, ends[at:end] - lo)
        at = end
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def doc_of(first: np.ndarray) -> np.ndarray:
    """Text index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow whose function gets slices of bounded text size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
