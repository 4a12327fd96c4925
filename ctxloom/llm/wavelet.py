"""Token-ID output: one wavelet matrix file per shard.

A shard's tokens are mapped to ranks in the shard's own sorted alphabet and stored as
ceil(log2(alphabet)) bit-planes. A plane is cut into blocks of 2**16 bits, each compressed on its
own, with the number of ones before each block in a directory. So access, rank, select, counting
and occurrence lookup decompress one block per plane and never the whole file; decoding the whole
shard undoes the planes' stable partitions from the last to the first.

File: b"CTXWM1\\0\\0", header length (u32), header (JSON, zstd), then the sections it names.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm import _base as B
from ctxloom.llm import tokens as T

MAGIC = b"CTXWM1\0\0"
BLOCK_BITS = 1 << 16
#: A shard is closed once it holds so many tokens; bounds a task's memory.
SHARD_TOKENS = 1 << 22


def encode(tokens: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, null_ids: np.ndarray | None = None) -> bytes:
    """The file of one shard. counts: tokens of each document; null_ids: which doc_ids stand for null."""
    pack = zstandard.ZstdCompressor(level=1).compress
    tokens = np.asarray(tokens)
    top = int(tokens.max()) + 1 if len(tokens) else 0
    seen = np.zeros(top, bool)
    seen[tokens] = True
    alphabet = np.flatnonzero(seen).astype("<u4")
    planes = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    rank = np.zeros(top, np.uint16 if planes <= 16 else np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    s = rank[tokens] if top else rank
    body, sections = [], []

    def put(data: bytes) -> list[int]:
        at = sum(sections)
        body.append(data)
        sections.append(len(data))
        return [at, len(data)]

    nulls = np.zeros(len(doc_ids), bool) if null_ids is None else null_ids
    head = {"n": len(tokens), "docs": len(doc_ids), "planes": planes, "block_bits": BLOCK_BITS, "alphabet": put(pack(alphabet.tobytes())),
            "doc_ids": put(pack(np.asarray(doc_ids, "<i8").tobytes())), "nulls": put(pack(np.packbits(nulls).tobytes())), "counts": put(pack(np.asarray(counts, "<i8").tobytes())), "zeros": [], "blocks": []}
    for p in range(planes - 1, -1, -1):
        bit = (s & s.dtype.type(1 << p)).astype(bool)
        ones, rest = np.flatnonzero(bit), np.flatnonzero(~bit)
        packed = np.packbits(bit).tobytes()
        step = BLOCK_BITS // 8
        before = np.searchsorted(ones, np.arange(0, max(1, len(tokens)), BLOCK_BITS)).tolist()
        head["zeros"].append(len(rest))
        head["blocks"].append([[*put(pack(packed[i * step: (i + 1) * step])), r] for i, r in enumerate(before)])
        s = np.concatenate([s[rest], s[ones]])
    raw = pack(json.dumps(head).encode())
    return MAGIC + struct.pack("<I", len(raw)) + raw + b"".join(body)


class Shard:
    """Reads one shard's file; only the blocks asked for are decompressed."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack_from("<I", data, 8)[0]
        self._unpack = zstandard.ZstdDecompressor().decompress
        self.head = json.loads(self._unpack(data[12: 12 + size]))
        self._data, self._base, self._cache = data, 12 + size, {}
        self.n, self.planes, self.zeros = self.head["n"], self.head["planes"], self.head["zeros"]
        self.alphabet = np.frombuffer(self._section("alphabet"), "<u4")
        self.doc_ids = np.frombuffer(self._section("doc_ids"), "<i8")
        self.nulls = np.unpackbits(np.frombuffer(self._section("nulls"), np.uint8))[: self.head["docs"]].astype(bool)
        self.counts = np.frombuffer(self._section("counts"), "<i8")

    def _section(self, name: str) -> bytes:
        at, size = self.head[name]
        return self._unpack(self._data[self._base + at: self._base + at + size])

    def _block(self, level: int, block: int) -> np.ndarray:
        """Bits of a block; the last few are kept."""
        if (level, block) not in self._cache:
            if len(self._cache) > 256:
                self._cache.clear()
            at, size, _ = self.head["blocks"][level][block]
            self._cache[level, block] = np.unpackbits(np.frombuffer(self._unpack(self._data[self._base + at: self._base + at + size]), np.uint8))
        return self._cache[level, block]

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block, rest = divmod(i, BLOCK_BITS)
        if block == len(self.head["blocks"][level]):
            return self.n - self.zeros[level]
        return self.head["blocks"][level][block][2] + int(self._block(level, block)[:rest].sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        blocks = self.head["blocks"][level]
        before = lambda b: blocks[b][2] if bit else b * BLOCK_BITS - blocks[b][2]
        lo, hi = 0, len(blocks) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if before(mid) <= k else (lo, mid - 1)
        return lo * BLOCK_BITS + int(np.flatnonzero(self._block(level, lo) == bit)[k - before(lo)])

    def _symbol(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        symbol = 0
        for level in range(self.planes):
            bit = int(self._block(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            symbol = symbol << 1 | bit
        return int(self.alphabet[symbol])

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.planes):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.planes - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        lo, hi = self._range(symbol, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(symbol, 0)[0] + k
        for level in range(self.planes - 1, -1, -1):
            bit = symbol >> (self.planes - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens, in order."""
        s = np.zeros(self.n, np.uint32 if self.planes > 16 else np.uint16)
        for level in range(self.planes - 1, -1, -1):
            bits = np.unpackbits(np.frombuffer(b"".join(self._unpack(self._data[self._base + a: self._base + a + n]) for a, n, _ in self.head["blocks"][level]), np.uint8))[: self.n].view(bool)
            up = np.empty_like(s)
            zeros = self.zeros[level]
            up[np.flatnonzero(~bits)] = s[:zeros]
            up[np.flatnonzero(bits)] = s[zeros:] | s.dtype.type(1 << (self.planes - 1 - level))
            s = up
        return self.alphabet[s] if self.n else np.zeros(0, "<u4")


#: Text bytes that a task encodes at once; more of them share more words.
SLICE = 4 << 20


def _put(path: str, name: str, data: bytes) -> None:
    """Write to the shared folder under another name, then move: a second attempt of a task replaces whole files only."""
    import uuid

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at, recursive=True)
    part = f"{at}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{at}/{name}")


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every whole text in ascending id order, end each with end_id and write wavelet shards under path.

    Returns (shard, n_tokens, n_docs), a row per file, already written. Null text is empty; null ids
    come first; rows of one id stay in the order of their text's hash. An empty table writes no shard.
    path must lie in a store all executors share.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held, ids, nulls, counts, total = [], [], [], [], 0
        coder = T.coder(tokenizer)

        def flush():
            nonlocal held, ids, nulls, counts, total, seq
            name = f"shard-{part:06d}-{seq:06d}.cwm"
            _put(path, name, encode(np.concatenate(held), np.concatenate(ids), np.concatenate(counts), np.concatenate(nulls)))
            out = pa.RecordBatch.from_pylist([{"shard": name, "n_tokens": total, "n_docs": int(sum(map(len, ids)))}], schema=pa.schema([("shard", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))
            held, ids, nulls, counts, total = [], [], [], [], 0
            seq += 1
            return out

        for batch in batches:
            for piece in B.slices(batch, limit=SLICE):
                toks, n = coder(piece.column("text"), end_id)
                col = piece.column("doc_id")
                held.append(toks)
                counts.append(n)
                nulls.append(np.asarray(col.is_null().to_numpy(zero_copy_only=False), bool))
                ids.append(col.fill_null(0).to_numpy(zero_copy_only=False))
                total += len(toks)
                if total >= SHARD_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return B.keep(rows.mapInArrow(run, "shard string, n_tokens long, n_docs long"), "shards")


def read_documents(spark, path: str, shards: DataFrame) -> DataFrame:
    """Read the shards back: doc_id, start, n_tokens, ids_crc32 and the shard of every document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cwm").load(path).select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")

    def run(batches):
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content")):
                w = Shard(data.as_py())
                raw = memoryview(w.tokens().astype("<u4").tobytes())
                ends = np.cumsum(w.counts)
                starts = ends - w.counts
                crc = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(crc), pa.string()), pa.array(w.doc_ids, mask=w.nulls), pa.array(starts), pa.array(w.counts), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = files.mapInArrow(run, "shard string, doc_id long, start long, n_tokens long, ids_crc32 long")
    # a row per file: offsets within a range of ids come first, then those of the ranges, a row for each of Spark's partitions
    part = F.split_part("shard", F.lit("-"), F.lit(2)).alias("part")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files_at = shards.select("shard", part, before(Window.partitionBy(part).orderBy("shard")).alias("within"))
    parts_at = shards.groupBy(part).agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("before"))
    at = files_at.join(parts_at, "part").select("shard", (F.col("within") + F.col("before")).alias("before"))
    return docs.join(at, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = B.new_path(spark, "wavelet")
    shards = write_shards(B.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_documents(spark, path, shards).drop("shard")
