"""Near-duplicate documents by Order MinHash and banded alignment.

Documents of equal words are one text (its copies are counted, not compared). For each of SKETCHES
hash functions a text keeps the ORDER least of its occurrence-labelled five-word shingles, in text
order; their joint hash is a bucket. Sensitive to edits: texts agree on a sketch if the chosen
shingles all survive, in the same order. At similarity 0.8 two texts share at least one of the 20
buckets with probability over 0.9999.

Candidates are verified by a banded alignment of their words: with m five-word shingles intact in the
alignment and n_a, n_b in all, the similarity m / (n_a + n_b - m) must be at least 0.8. Before that,
the shared shingles give a bound of the similarity that most unrelated pairs fail. 1 - that bound is a
metric, and so link() can leave out comparisons that cannot succeed. Classes are the connected components of verified
pairs. Texts under five words have one shingle: all their words. Texts without words, null ones
included, are never linked: each row of another id or text is a class of its own.

Ties: rows of equal id and text are one row to stage(), and members of one class to classes(); null ids come
last. Very long texts are aligned whole, in rows of the band's width. An empty table gives an empty one, and
further columns pass through stage() whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm import _base as B
from ctxloom.llm._links import SHARE, link

SKETCHES, ORDER = 20, 4
SHINGLE = 5
SIMILARITY = 0.8
_AT = 28  # bits of a shingle's place
_SEEDS = np.random.default_rng(11).integers(1, 1 << 62, SKETCHES, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def shingles(h: np.ndarray, first: np.ndarray, k: int = SHINGLE):
    """(hashes, first shingle of each text): k-word shingles labelled by their occurrence number; shorter texts have one."""
    n = np.diff(first)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    start = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], size)
    g = B.span_hashes(h, start, start + np.repeat(np.minimum(n, k), size))
    doc = np.repeat(np.arange(len(n)), size)
    order = np.lexsort((g, doc))
    same = np.zeros(len(g), bool)
    same[1:] = (g[order][1:] == g[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    if same.any():  # how many equal ones come before in its text
        run = np.flatnonzero(~same)
        nth = np.empty(len(g), np.int64)
        nth[order] = np.arange(len(g)) - np.repeat(run, np.diff(np.append(run, len(g))))
        g = np.where(nth > 0, B.mix(g + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), g)
    return g, begin


def sketch(g: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """texts x SKETCHES joint hashes of the ORDER least shingles in text order; texts must have shingles."""
    at = begin[:-1]
    n = np.diff(begin)
    place = (np.arange(begin[-1]) - np.repeat(at, n)).astype(np.uint64)
    mask = np.uint64((1 << _AT) - 1)
    out = np.empty((len(n), SKETCHES), np.uint64)
    for s in range(SKETCHES):
        x = g * _SEEDS[s]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x = (x & ~mask) | place
        chosen = np.empty((len(n), ORDER), np.int64)
        for k in range(ORDER):
            least = np.minimum.reduceat(x, at)
            chosen[:, k] = (least & mask).astype(np.int64)
            left = n > k
            chosen[~left, k] = -1
            x[at[left] + chosen[left, k]] = np.uint64((1 << 64) - 1)
        chosen.sort(axis=1)
        joint = np.full(len(n), s + 1, np.uint64)
        for k in range(ORDER):
            there = chosen[:, k] >= 0
            joint = np.where(there, B.mix(joint * np.uint64(0x9E3779B97F4A7C15) ^ g[at + np.maximum(chosen[:, k], 0)]), joint)
        out[:, s] = joint
    return out


def _align(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(edit distance, intact shingles) of padded word rows along a least-cost path within +-width of the diagonal.

    Each cell holds cost * BIG - shingles, so a least value has the fewest edits and, among those paths
    kept, the most words in intact shingles; run counts the matches just before a cell.
    """
    big = np.int64(1 << 32)
    p, w = len(a), 2 * width + 1
    off = np.arange(w)[:, None] - width
    far = np.int64(1 << 60)
    cost = np.where(off >= 0, off * big, far).repeat(p, axis=1)
    run = np.zeros((w, p), np.int64)
    last = np.clip(nb - na, -width, width) + width
    end = np.where(na == 0, cost[last, np.arange(p)], far)
    left = np.ascontiguousarray(a.T)
    rows = np.full((width + max(a.shape[1], b.shape[1]) + width + 1, p), -2, b.dtype)
    rows[width: width + b.shape[1]] = b.T
    step = np.arange(w)[:, None] * big
    diag, more, same, long = np.empty_like(cost), np.empty_like(cost), np.empty((w, p), bool), np.empty((w, p), bool)
    ends = np.argsort(na, kind="stable")
    ended = np.searchsorted(na[ends], np.arange(a.shape[1] + 2))
    for i in range(a.shape[1]):
        # row j of the band at step i + 1 stands for b position i + 1 + off[j]
        eq = rows[i: i + w] == left[i]
        np.add(cost, big, out=more)
        np.greater_equal(run, SHINGLE - 1, out=long)
        np.subtract(cost, long, out=diag)
        np.copyto(diag, more, where=~eq)
        np.minimum(diag[:-1], more[1:], out=cost[:-1])
        cost[-1] = diag[-1]
        cost -= step
        np.minimum.accumulate(cost, axis=0, out=cost)
        cost += step
        np.equal(cost, diag, out=same)
        same &= eq
        run += 1
        run *= same
        if i + 1 < width:
            cost[: width - i - 1] = far
        if ended[i + 2] > ended[i + 1]:
            done = ends[ended[i + 1]: ended[i + 2]]
            end[done] = cost[last[done], done]
    edits = -(-end // big)
    return edits, (edits * big - end)


def _verify(texts_a: list, texts_b: list, similarity: float):
    """(distance by shared shingles, whether verified) of each pair."""
    n = len(texts_a)
    dist, ok = np.ones(n), np.zeros(n, bool)
    code: dict = {}
    at = [code.setdefault(t, len(code)) for t in (*texts_a, *texts_b)]
    held = []  # words and sorted shingles of each different text
    for part in B.slices(pa.record_batch([pa.array(list(code), pa.string())], ["text"])):
        raw, off = B.text_bytes(part.column("text"))
        s, e, first = B.word_spans(raw, off)
        h = B.word_hashes(raw, s, e)
        g, begin = shingles(h, first)
        h = B.signed(h)
        held += [(h[first[i]: first[i + 1]], np.sort(g[begin[i]: begin[i + 1]])) for i in range(part.num_rows)]

    words, gs, need = [], [], []
    for i in range(n):
        (ha, ga), (hb, gb) = held[at[i]], held[at[n + i]]
        few, many = (ga, gb) if len(ga) < len(gb) else (gb, ga)
        m = np.count_nonzero(many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few) if len(few) else 0
        dist[i] = 1 - m / max(1, len(ga) + len(gb) - m)
        words.append((ha, hb))
        gs.append(len(ga) + len(gb))
        if 1 - dist[i] >= similarity:
            if min(len(ha), len(hb)) < SHINGLE:
                ok[i] = len(ha) == len(hb) and bool((ha == hb).all())
            else:
                need.append(i)
    width = 8
    while need:
        need.sort(key=lambda i: len(words[i][0]))
        left = []
        room = max(1, 2_000_000 // (2 * width + 1))
        for lo in range(0, len(need), 64):
            part = need[lo: lo + 64]
            wide = max(len(words[i][0]) for i in part)
            for cut in range(0, len(part), max(1, room // max(1, 64))):
                few = part[cut: cut + max(1, room // 64)]
                na, nb = (np.array([len(words[i][k]) for i in few]) for k in (0, 1))
                a, b = np.full((len(few), na.max()), -1, np.int64), np.full((len(few), nb.max()), -3, np.int64)
                for r, i in enumerate(few):
                    a[r, : na[r]], b[r, : nb[r]] = words[i]
                edits, m = _align(a, b, na, nb, width)
                for r, i in enumerate(few):
                    # a path that never needs to leave the band is a best one
                    if abs(na[r] - nb[r]) <= width and m[r] / max(1, gs[i] - m[r]) >= similarity:
                        ok[i] = True
                    elif width < wide and width < 0.25 * max(na[r], nb[r]) + 8:
                        left.append(i)
        need, width = left, width * 4
    return dist, ok


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, labels): rows (key, doc_id, text_id) and (text_id, label) of the texts that are linked to another one.

    key is the caller's key of a row. Only the texts of candidates move, and those only to be verified.
    """

    def cut(part: pa.RecordBatch):
        raw, off = B.text_bytes(part.column("text"))
        s, e, first = B.word_spans(raw, off)
        h = B.word_hashes(raw, s, e)
        some = np.diff(first) > 0
        tid = B.span_hashes(h, first[:-1], first[1:])
        tid[~some] = B.mix(part.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[~some])
        bands = [[] for _ in range(part.num_rows)]
        if some.any():
            g, begin = shingles(h, first)
            full = np.append(begin[:-1][some], begin[-1])
            for i, row in zip(np.flatnonzero(some), B.signed(sketch(g, full)).tolist()):
                bands[i] = row
        return pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(B.signed(tid)), pa.array(np.diff(first).astype(np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["key", "doc_id", "text_id", "n_words", "bands"])

    # equal rows are one row here; the caller's key brings them back
    rows = B.keep(B.arrow_map(docs.select("key", "doc_id", "text"), cut, "key long, doc_id long, text_id long, n_words long, bands array<long>"), "sketches")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "key")).alias("first")
    text = B.keep(rows.groupBy("text_id").agg(first, F.first("n_words").alias("n_words"), F.first("bands").alias("bands")), "texts")
    size = F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1))
    # only buckets and ids move to find buckets of two and more; the rest is fetched for what is left
    spread = text.select(F.explode("bands").alias("bucket"), F.col("text_id").alias("id"))
    crowd = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    found = B.keep(spread.join(B.moved(crowd), "bucket"), "buckets")
    asked = text.select(F.col("text_id").alias("id"), F.col("first.d").alias("ord"), size.alias("size"), F.col("first.key").alias("key")).join(B.moved(found.select("id").distinct()), "id", "left_semi")
    held = docs.select("key", "text").join(B.moved(asked), "key").groupBy("id").agg(*(F.first(c).alias(c) for c in ("ord", "size", "text")))
    held = B.keep(held, "candidate-texts")
    B.forget(text)
    member = B.keep(found.join(held.select("id", "ord", "size"), "id").withColumn("tol", F.lit(1 - similarity)), "candidates")
    B.forget(found)

    def verify(pairs: DataFrame) -> DataFrame:
        p = B.moved(pairs).join(held.select(F.col("id").alias("a"), F.col("text").alias("text")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")

        def run(part: pa.RecordBatch):
            dist, ok = _verify(part.column("text").to_pylist(), part.column("other").to_pylist(), similarity)
            return pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(dist), pa.array(ok)], ["a", "b", "dist", "ok"])

        return B.arrow_map(p, run, "a long, b long, dist double, ok boolean")

    def features(ids: DataFrame) -> DataFrame:
        def run(part: pa.RecordBatch):
            raw, off = B.text_bytes(part.column("text"))
            s, e, first = B.word_spans(raw, off)
            g, begin = shingles(B.word_hashes(raw, s, e), first)
            # near copies share most shingles: one row for all of them that stand in this batch
            g, at, n = np.unique(g, return_index=True, return_counts=True)
            owner = np.searchsorted(begin, at, side="right") - 1
            return pa.RecordBatch.from_arrays([pa.array(B.signed(g)), pa.array(n.astype(np.int64)), part.column("id").take(pa.array(owner))], ["feature", "n", "id"])

        return B.arrow_map(held.join(ids, "id").select("id", "text").repartition("id"), run, "feature long, n long, id long")

    labels = link(member, verify, features=features)
    for x in (member, held):
        B.forget(x)
    return rows.select("key", "doc_id", "text_id"), labels.select(F.col("id").alias("text_id"), "label")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, doc_id, class_id, n_members, first): class_id is the class's least doc_id, n_members its number of rows
    (of any text), first whether the row is the class's first one (by doc_id, then key)."""
    rows, labels = near_duplicates(docs, similarity)
    # both joins read written tables, so that Spark can split a text or class that holds many of the rows
    r = rows.join(labels, "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
    best = r.groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "doc_id", "key")).alias("best"), F.count("*").alias("n_members"))
    r = r.join(B.keep(best, "firsts"), "label")
    return r.select("key", "doc_id", F.col("best.doc_id").alias("class_id"), "n_members", (F.col("key") == F.col("best.key")).alias("first"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs.withColumn("key", B.row_key(F.col("doc_id"), F.col("text")))).select("doc_id", "class_id", "n_members")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the first document of each class stays; of rows that are equal in id and text, one does."""
    key, row = B.private(docs, "key", "row")
    keyed = docs.withColumn(key, B.row_key(F.col("doc_id"), F.col("text")))
    first = classes(keyed.select(F.col(key).alias("key"), "doc_id", "text")).where("first").select(F.col("key").alias(key))
    # equal rows are one before they move
    one = keyed.groupBy(key).agg(F.first(F.struct(*docs.columns)).alias(row))
    return one.join(first, key, "left_semi").select(F.col(f"{row}.*"))
