"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items.

Items are numbered and cut into blocks; the inverted index lists each term's postings by item with
BM25 impacts, and keeps each term's largest impact per block. An item's impacts are divided by their
sum, so a score is the share of the item's BM25 mass that a passage holds, and one threshold suits
all items. Passages are word windows that overlap by the longest item of the whole benchmark, so every
occurrence lies whole in one and no result depends on the shards. Block-max WAND retrieves all items
over the threshold: a passage's terms give an upper bound per region of blocks (for all passages of a
batch at once); in regions that may pass, the posting lists are walked with a pivot, by the lists'
largest impacts and then by those of the pivot's block. Each hit is verified: the item's
question and its answer (the text after the last line feed, or else its last sentence, or else its
last third) must each have at least MIN_OVERLAP of their five-word shingles (or words, if shorter) in
the passage, or of their words in an ordered alignment with a stretch of it, so that an edited word
costs a part of n words 1 / n. Parts of under five words must be whole.

Shards of about SHARD_POSTINGS words are built in tasks of their own and written to the shared folder.
One after the other is broadcast (a shard's postings and REGION_CELLS bounds limit its size), so a
benchmark of any size works; the corpus is scanned once a shard and never shuffled.

Words are [^\\x20\\x09-\\x0D]+, lower-cased, edge punctuation off. Null and empty texts hit nothing;
items without words match nothing; repeated items are items of their own; equal rows of documents
give one row per document id and item. Ties of score go to the first passage; very long texts are searched passage by
passage, whole; empty tables give no rows; stage() passes further columns through whatever their names.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm import _base as B

K1, BIAS = 1.2, 0.75
THRESHOLD = 0.7
MIN_OVERLAP = 0.8
SHINGLE = 5
BLOCK = 8
#: Words of the items of one shard of the index, about; cells of its table of bounds (terms x regions, four bytes each).
SHARD_POSTINGS, REGION_CELLS = 1_000_000, 4_000_000


def words_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text)."""
    raw, off = B.lower_bytes(col)
    starts, ends, first = B.word_spans(raw, off)
    starts, ends = B.edges_off(raw, starts, ends)
    full = starts < ends
    before = np.concatenate([[0], np.cumsum(full)])
    return B.word_hashes(raw, starts[full], ends[full]), before[first]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item's text."""
    text = (text or "").strip()
    head, mark, tail = text.rpartition("\n")
    if mark and head.strip() and tail.strip():
        return head, tail
    parts = re.split(r"(?<=[.!?])\s+", text)
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    cut = len(w) - max(1, len(w) // 3)
    return " ".join(w[:cut]), " ".join(w[cut:])


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Distinct word n-gram hashes (of all words at once if there are fewer than n)."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    n = min(n, len(h))
    i = np.arange(len(h) - n + 1)
    return np.unique(B.span_hashes(h, i, i + n))


def aligned(part: np.ndarray, text: np.ndarray) -> float:
    """1 - edits / words of the part, for the fewest word edits that make it a stretch of the text."""
    at = np.arange(len(text) + 1)
    d = np.zeros(len(text) + 1, np.int64)
    for k, w in enumerate(part, 1):
        e = np.concatenate([[k], np.minimum(d[:-1] + (text != w), d[1:] + 1)])
        d = np.minimum.accumulate(e - at) + at
    return 1 - int(d.min()) / len(part)


@dataclass
class Index:
    """A shard: terms sorted by hash; postings of term t are items[first[t]:first[t + 1]], ascending, with impacts."""

    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray
    impact: np.ndarray
    most: np.ndarray  # largest impact of each posting's list within the posting's block
    region: int  # items in a region
    bound: np.ndarray  # terms x regions, float32
    ids: list
    parts: list  # per item: ((question shingles, their length, words), (answer shingles, length, words))
    longest: int  # words of the longest item of the whole benchmark

    @staticmethod
    def build(rows: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_len: float, longest: int) -> Index:
        terms, items, weights, ids, parts = [], [], [], [], []
        for item_id, text in rows:
            h, _ = words_of(pa.array([text or ""]))
            if not len(h):
                continue
            t, tf = np.unique(h, return_counts=True)
            d = np.array([df[x] for x in t.tolist()], float)
            w = np.log1p((n_items - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - BIAS + BIAS * len(h) / mean_len))
            terms.append(t)
            weights.append(w / w.sum())
            items.append(np.full(len(t), len(ids), np.int32))
            ids.append(item_id)
            qa = []
            for part in split_item(text):
                p = words_of(pa.array([part]))[0]
                qa.append((shingles(p), min(SHINGLE, len(p)), p))
            parts.append(qa)
        if not ids:
            z = np.zeros(0)
            return Index(z.astype(np.uint64), np.zeros(1, np.int64), z.astype(np.int32), z, z, BLOCK, np.zeros((0, 1), np.float32), [], [], longest)
        t, i, w = np.concatenate(terms), np.concatenate(items), np.concatenate(weights)
        order = np.lexsort((i, t))
        t, i, w = t[order], i[order], w[order]
        names, first = np.unique(t, return_index=True)
        of = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(t))))
        new = np.append(True, (of[1:] != of[:-1]) | (i[1:] // BLOCK != i[:-1] // BLOCK))
        most = np.maximum.reduceat(w, np.flatnonzero(new))[np.cumsum(new) - 1]
        blocks = -(-len(ids) // BLOCK)
        region = BLOCK * -(-blocks // max(1, min(blocks, REGION_CELLS // len(names))))
        bound = np.zeros((len(names), -(-len(ids) // region)), np.float32)
        np.maximum.at(bound, (of, i // region), w.astype(np.float32) * 1.0001)
        return Index(names, np.append(first, len(t)), i, w, most, region, bound, ids, parts, longest)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words of no item."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def search(self, terms: np.ndarray, regions: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND over the given regions: all (item, score) of at least threshold for a passage's distinct terms."""
        return [x for r in regions.tolist() for x in self._search(terms[self.bound[terms, r] > 0], r, threshold)]

    def _search(self, terms: np.ndarray, region: int, threshold: float) -> list[tuple[int, float]]:
        found, lists = [], []  # a list: item at its cursor, cursor, end, largest impact in this region
        for t in terms.tolist():
            a, b = self.first[t], self.first[t + 1]
            lo, hi = a + np.searchsorted(self.items[a:b], (region * self.region, (region + 1) * self.region))
            lists.append([int(self.items[lo]), int(lo), int(hi), float(self.bound[t, region])])
        slack = threshold - 1e-9  # sums in another order differ in their last places

        def advance(some: list, to: int) -> None:
            for x in some:
                x[1] += int(np.searchsorted(self.items[x[1]: x[2]], to))
                if x[1] < x[2]:
                    x[0] = int(self.items[x[1]])

        while lists:
            lists.sort(key=lambda x: x[0])
            total, n = 0.0, 0
            while n < len(lists) and total < slack:
                total += lists[n][3]
                n += 1
            if total < slack:
                break
            pivot = lists[n - 1][0]
            while n < len(lists) and lists[n][0] == pivot:
                n += 1
            ahead, end = lists[:n], (pivot // BLOCK + 1) * BLOCK
            # lists that are behind stand at the pivot's block or later before their block's bound is read
            advance([x for x in ahead if x[0] < pivot // BLOCK * BLOCK], pivot // BLOCK * BLOCK)
            cap = sum(float(self.most[x[1]]) for x in ahead if x[1] < x[2] and x[0] < end)
            if cap < slack:
                advance([x for x in ahead if x[1] < x[2]], min([end, *(x[0] for x in lists[n:])]))
            else:
                advance([x for x in ahead if x[1] < x[2] and x[0] < pivot], pivot)
                here = [x for x in ahead if x[1] < x[2] and x[0] == pivot]
                score = sum(float(self.impact[x[1]]) for x in here)
                if score >= slack:
                    found.append((pivot, score))
                advance(here, pivot + 1)
            lists = [x for x in lists if x[1] < x[2]]
        return found


def _passages(n: int, longest: int) -> list[tuple[int, int]]:
    """Word windows of a text: twice the longest item, moved by it, so any run of that length is in one."""
    step = max(longest, 32)
    return [(a, min(n, a + 2 * step)) for a in range(0, max(1, n - step), step)]


def _hits(index: Index, piece: pa.RecordBatch, threshold: float, overlap: float) -> list[tuple]:
    h, first = words_of(piece.column("text"))
    t = index.lookup(h)
    docs, lo, hi = [], [], []
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        for x, y in _passages(b - a, index.longest) if b > a else ():
            docs.append(d)
            lo.append(a + x)
            hi.append(a + y)
    if not docs or not len(index.terms):
        return []
    # distinct known terms of each passage
    lo_, hi_ = np.array(lo), np.array(hi)
    size = hi_ - lo_
    at = np.repeat(lo_ - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    key = np.repeat(np.arange(len(docs)), size) * (len(index.terms) + 1) + t[at] + 1
    key = np.unique(key[t[at] >= 0])
    passage, term = key // (len(index.terms) + 1), key % (len(index.terms) + 1) - 1
    ends = np.searchsorted(passage, np.arange(len(docs) + 1))
    some = np.flatnonzero(np.diff(ends))
    out = []
    step = max(1, 4_000_000 // max(1, index.bound.shape[1] * 128))
    for k in range(0, len(some), step):
        ps = some[k: k + step]
        a, b = ends[ps[0]], ends[ps[-1] + 1]
        upper = np.add.reduceat(index.bound[term[a:b]], ends[ps] - a, axis=0)
        rows, regions = np.nonzero(upper >= threshold)
        for r in np.unique(rows):
            p = ps[r]
            for item, score in index.search(term[ends[p]: ends[p + 1]], regions[rows == r], threshold):
                text = h[lo[p]: hi[p]]
                shares = []
                for sh, n, part in index.parts[item]:
                    shares.append(1.0 if not len(sh) else float(np.isin(sh, shingles(text, n)).mean()) if len(text) >= n else 0.0)
                    if shares[-1] < overlap:
                        shares[-1] = max(shares[-1], aligned(part, text))
                if min(shares) >= overlap:
                    out.append((docs[p], index.ids[item], lo[p] - int(first[docs[p]]), hi[p] - int(first[docs[p]]), score, shares[0], shares[1]))
    return out


def _shards(benchmark: DataFrame) -> tuple[DataFrame | None, int]:
    """(shard, index) with one pickled index a shard, each built in one task from a bounded part of the items, and their number."""

    def sizes(piece: pa.RecordBatch):
        n = np.diff(words_of(piece.column("text"))[1])
        return pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), piece.column("item_id"), piece.column("text")], ["n", "item_id", "text"])

    def count(piece: pa.RecordBatch):
        h, first = words_of(piece.column("text"))
        shard = piece.column("shard").to_numpy(zero_copy_only=False)[B.doc_of(first)]
        pairs = np.unique(np.stack([B.doc_of(first), shard, B.signed(h)]), axis=1)[1:]
        (s, t), n = np.unique(pairs, axis=1, return_counts=True) if pairs.size else (pairs, pairs[0])
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(t), pa.array(n.astype(np.int64))], ["shard", "term", "n"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    sized = B.keep(B.arrow_map(items, sizes, "n long, item_id long, text string").where(F.col("n") > 0), "items")
    total = sized.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("n").alias("longest")).first()
    if not total["k"]:
        return None, 0
    k, mean, longest, n_shards = total["k"], total["n"] / total["k"], total["longest"], -(-total["n"] // SHARD_POSTINGS)
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("item_id", "text", "n"), F.lit(n_shards)).cast("long"))
    terms = B.keep(B.arrow_map(sized.select("shard", "text"), count, "shard long, term long, n long").groupBy("shard", "term").agg(F.sum("n").alias("n")), "terms")
    known = terms.select("shard", "term").join(terms.groupBy("term").agg(F.sum("n").alias("n")), "term")

    def build(part: pa.Table, df: pa.Table) -> pa.Table:
        rows = sorted(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen = dict(zip(df.column("term").to_numpy().view(np.uint64).tolist(), df.column("n").to_pylist()))
        return pa.table({"shard": part.column("shard").slice(0, 1), "index": pa.array([pickle.dumps(Index.build(rows, seen, k, mean, longest))], pa.binary())})

    built = sized.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(build, "shard long, index binary")
    return B.keep(built, "index"), n_shards


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = MIN_OVERLAP) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, score, question_overlap, answer_overlap): the best passage of each verified pair."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, first_word int, end_word int, score double, question_overlap double, answer_overlap double"
    found = None
    index, n_shards = _shards(benchmark)
    for shard in range(n_shards):
        row = index.where(F.col("shard") == shard).first()  # of bounded size
        if row is None:
            continue
        held = spark.sparkContext.broadcast(pickle.loads(bytes(row["index"])))

        def run(piece: pa.RecordBatch, held=held):
            hits = _hits(held.value, piece, threshold, overlap)
            ids = piece.column("doc_id")
            return pa.RecordBatch.from_arrays([ids.take(pa.array([x[0] for x in hits], pa.int64())), *(pa.array([x[k] for x in hits], ty) for k, ty in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.float64()), (5, pa.float64()), (6, pa.float64())))], ["doc_id", "item_id", "first_word", "end_word", "score", "question_overlap", "answer_overlap"])

        part = B.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
        if n_shards > 1:  # one shard at a time in memory
            part = B.keep(part, "hits")
            held.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.max_by(F.struct("first_word", "end_word", "score", "question_overlap", "answer_overlap"), F.struct("score", -F.col("first_word"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def op1(spark, sf_dir: str) -> DataFrame:
    return find(B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a test item go."""
    (key,) = B.private(docs, "key")
    keyed = docs.withColumn(key, B.row_key(F.col("doc_id"), F.col("text")))
    bad = find(keyed.select(F.col(key).alias("doc_id"), "text"), B.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
