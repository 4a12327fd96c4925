"""Periodic runs of words: stretches that repeat a block of words three times or more.

Method: a harmonic grid. For each period p the words jp and (j+1)p of a document are compared by their longest common
extension (LCE) forward and backward, n/3 + n/6 + ... pairs in all. Both extensions come from a suffix array each, of the
text and of the reversed text, with range minima over the common prefixes of neighbours. A run of three periods holds
three grid words jp, (j+1)p, (j+2)p and, beside them, three more equal words on one side: a pair for which these few
words differ has extensions too short for a run, and needs no query.

Every document is one unit of work, so the operator is one scan without any shuffle; a task handles about 2 MB of
text at a time and needs a few hundred bytes a word.

Defined results: a null or empty text has no words and no runs. A null id leaves the words as they are. Repeated rows give
a row each. Ties of the strongest run go to the smallest start, then the smallest period. Other columns of the table are
not read. An empty table gives no rows. A text of any length is one unit: it is never cut.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import _base

#: A run has this many words and periods at least.
MIN_WORDS = 24
MIN_PERIODS = 3
#: Grid pairs that are compared in one step.
STEP = 1_000_000

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


class Extensions:
    """Longest common extensions of positions of one sequence: suffix array, common prefixes of neighbours, range minima.

    Symbols of different documents must differ, so no extension leaves its document.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        head = np.flatnonzero(np.r_[True, symbols[order[1:]] != symbols[order[:-1]]])
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(head, np.diff(np.r_[head, n]))
        levels, width = [rank.astype(np.int32)], 1
        live = order[self._shared(rank[order])]
        while len(live):  # suffixes that share their first `width` symbols with another one
            ahead = live + width
            second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
            first = rank[live]
            by = np.argsort(first * (n + 1) + second + 1, kind="stable")
            live, first, second = live[by], first[by], second[by]
            group = np.r_[True, first[1:] != first[:-1]]
            at = np.arange(len(live))
            place = first + at - at[group][np.cumsum(group) - 1]
            new = group | np.r_[True, second[1:] != second[:-1]]
            order[place] = live
            settled = place[new][np.cumsum(new) - 1]
            rank = rank.copy()
            rank[live] = settled
            levels.append(rank.astype(np.int32))
            live = live[self._shared(settled)]
            width *= 2
        common = np.zeros(n, np.int64)
        pair = np.flatnonzero(np.r_[False, levels[0][order[1:]] == levels[0][order[:-1]]])
        a, b, have = order[pair - 1], order[pair], np.zeros(len(pair), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + have, b + have
            inside = (x < n) & (y < n)
            same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
            have += same.astype(np.int64) << k
        common[pair] = have
        self.rank, self.minima = rank, [common.astype(np.int32)]
        while 2 << (len(self.minima) - 1) <= n:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _shared(rank: np.ndarray) -> np.ndarray:
        """Whether a neighbour in sorted order has the same rank."""
        same = rank[1:] == rank[:-1]
        return np.r_[same, False] | np.r_[False, same]

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1  # a half-open range of neighbours
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.minima[k][lo[of]], self.minima[k][hi[of] - (1 << int(k))])
        return out


def grid_pairs(words: np.ndarray, start: np.ndarray, size: np.ndarray):
    """(document, position, period) of the grid pairs whose words don't rule out a run at once."""
    top = np.where(size >= MIN_WORDS, size // MIN_PERIODS, 0)
    doc = np.repeat(np.arange(len(size)), top)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(top) - top, top) + 1
    count = (size[doc] - 1) // np.maximum(period, 1) - 1
    done = np.cumsum(count)
    found = []
    lo = 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + STEP, side="right")))
        c = count[lo:hi]
        p = np.repeat(period[lo:hi], c)
        q = np.repeat(start[doc[lo:hi]], c) + (np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)) * p
        at = np.flatnonzero(words[q] == words[q + p])
        p, q = p[at], q[at]
        d = np.repeat(doc[lo:hi], c)[at]
        at = np.flatnonzero(words[q] == words[q + 2 * p])
        d, p, q = d[at], p[at], q[at]
        end = start[d] + size[d]
        last = len(words) - 1
        x = np.minimum(q + 1 + 2 * p, last)
        after = (q + 1 + 2 * p < end) & (words[np.minimum(q + 1, last)] == words[np.minimum(q + 1 + p, last)]) & (words[np.minimum(q + 1, last)] == words[x])
        before = (q > start[d]) & (words[q - 1] == words[q - 1 + p]) & (words[q - 1] == words[q - 1 + 2 * p])
        at = np.flatnonzero(after | before | (p == 1))
        found.append((d[at], q[at], p[at]))
        lo = hi
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def find_runs(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in it, length, period) of all runs, by document, start and period. words: ids of the words of all documents in turn."""
    size = np.asarray(size, np.int64)
    start = np.cumsum(size) - size
    doc, at, period = grid_pairs(words, start, size)
    if not len(doc):
        return doc, at, period, period
    # arrays over the documents that have such pairs
    some = np.unique(doc)
    own_size = size[some]
    own_start = np.cumsum(own_size) - own_size
    text = np.repeat(np.arange(len(some)), own_size)
    here = np.arange(len(text)) - own_start[text]
    symbols = text * (int(words.max()) + 1) + words[start[some][text] + here]
    mirror = own_start[text] + own_size[text] - 1 - here
    d = np.searchsorted(some, doc)
    i = at - start[doc] + own_start[d]
    j = i + period
    forward = Extensions(symbols).lce(i, j)
    backward = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > own_start[d])
    backward[inner] = Extensions(symbols[mirror]).lce(mirror[i[inner] - 1], mirror[j[inner] - 1])
    lo, hi = i - backward, j + forward
    length = hi - lo
    ok = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
    d, lo, length, period = d[ok], lo[ok], length[ok], period[ok]
    by = np.lexsort((period, length, lo))  # of the periods of one stretch, the smallest
    d, lo, length, period = d[by], lo[by], length[by], period[by]
    new = np.r_[True, (lo[1:] != lo[:-1]) | (length[1:] != length[:-1])] if len(lo) else np.zeros(0, bool)
    d, lo, length, period = d[new], lo[new], length[new], period[new]
    by = np.lexsort((period, lo))
    return some[d[by]], (lo - own_start[d])[by], length[by], period[by]


def repeat_tail(doc_id: int, words: list) -> list:
    """The words as the query takes them: of one document in ten, by the checksum of its id, the words from some place on repeat."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a: a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def _batch(part: pa.RecordBatch, change) -> pa.RecordBatch:
    ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
    split = [(t or "").encode().split() for t in texts]  # splits at 0x20 and 0x09 to 0x0D, as bytes do
    if change:
        split = [w if i is None else change(i, w) for i, w in zip(ids, split, strict=True)]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    known = defaultdict()
    known.default_factory = known.__len__
    words = np.fromiter((known[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
    doc, start, length, period = find_runs(words, sizes)
    edges = np.searchsorted(doc, np.arange(len(ids) + 1))
    out = []
    for k, ws in enumerate(split):
        runs = list(zip(*(x[edges[k]: edges[k + 1]].tolist() for x in (start, length, period)), strict=True))
        keep = ws
        if runs:
            drop = np.zeros(len(ws) + 1, np.int64)
            for s, n, p in runs:
                drop[s + p] += 1
                drop[s + n] -= 1
            keep = [w for w, x in zip(ws, np.cumsum(drop).tolist(), strict=False) if not x]
            s, n, p = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            best = (s, n, p, 1000 * n // p)
        else:
            best = (None,) * 4
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        out.append((ids[k], len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(keep)).hexdigest(), len(ws), len(ws) - len(keep), listed, b" ".join(keep).decode()))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()] * 2
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped", "runs", "collapsed"]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def collapse(docs: DataFrame, change=None, texts: bool = True) -> DataFrame:
    """A row per document with its runs, its strongest run and its words without the repeats of each run.

    texts: also return `runs` (lines `start,length,period`) and the collapsed text itself.
    change: (doc_id, words) -> words, applied before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def one(part):
        out = _batch(part, change)
        return out if texts else out.select(names)

    return _base.arrow_map(rows, one, SCHEMA + (", runs string, collapsed string" if texts else ""))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, some of which have a repeated tail."""
    return collapse(_base.table(spark, sf_dir, "documents"), repeat_tail, texts=False)
