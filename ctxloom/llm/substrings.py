"""Substring dedup: repeated word windows removed, by compacting a de Bruijn graph of the corpus.

A window is `window` consecutive words [^\\x20\\x09-\\x0D]+ of one document, unchanged: an edge of the
graph. Removed is each word covered by a window that also starts in a document with a smaller id.

1. Windows that follow each other and share a minimizer (the least hash of their 20-word runs) form a
   piece, found inside a document without a shuffle; a window of 50 words makes about one piece in 16
   words. Equal windows share their minimizer, so pieces whose minimizer one document alone holds go.
2. Pieces are the nodes left. Where all occurrences of a minimizer are the same piece, the piece is
   clean. Other pieces are opened: one representative each, fetched by its source coordinates and
   verified against its hash, gives its window hashes; the least document of each hash is the answer.
3. Nonbranching paths compact: a clean piece goes on the path of the piece before it if each is the
   other's only neighbour in every document. In- and out-neighbours come from each document's own
   order, then two joins tell where paths begin; one running count a document turns pieces into spans.
4. A span's source is its first piece's; spans with an earlier source are removed from the text.

All joins are on hashes or ids with one row a key on one side, so hot passages split. Null texts have
no words; null ids count as larger than any; rows of one id are told apart by a tag of their text
(equal rows repeat their result and never remove each other's words); texts under `window` words stay.
Texts of any length are handled whole; an empty table gives no rows; columns but doc_id and text are not read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm import _base as B

WINDOW = 50
MINIMIZER = 20
#: Most windows of one piece.
PIECE = 64
LAST = (1 << 63) - 1


def _slide_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbouring values."""
    span, m = 1, h
    while 2 * span <= w:
        m = np.minimum(m[:-span], m[span:]) if len(m) > span else m[:0]
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest and len(m) > rest else m if not rest else m[:0]


def _pieces(h: np.ndarray, first: np.ndarray, window: int):
    """(text, first word in it, windows, minimizer, hash) of each piece."""
    k = min(MINIMIZER, window)
    n = len(h)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    i = np.arange(n - k + 1)
    least = _slide_min(B.span_hashes(h, i, i + k), window - k + 1)
    doc = B.doc_of(first)
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1:])  # windows inside one text
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    m = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    # long runs are cut, counted from their start
    since = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(new | (since % PIECE == 0))
    size = np.diff(np.append(head, len(at)))
    start = at[head]
    return doc[start], start - first[doc[start]], size, m[head], B.span_hashes(h, start, start + size + window - 1)


def _words(col: pa.Array):
    raw, off = B.text_bytes(col)
    starts, ends, first = B.word_spans(raw, off)
    return B.word_hashes(raw, starts, ends), first


def find_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, tag, start, end, source): word spans to remove and the document that has them first."""
    keyed = docs.select("d", "tag", "text")

    def cut(part: pa.RecordBatch):
        doc, pos, size, least, whole = _pieces(*_words(part.column("text")), window)
        take = pa.array(doc)
        return pa.RecordBatch.from_arrays([part.column("d").take(take), part.column("tag").take(take), pa.array(pos.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(B.signed(least)), pa.array(B.signed(whole))], ["d", "tag", "pos", "size", "least", "piece"])

    pieces = B.keep(B.arrow_map(keyed, cut, "d long, tag long, pos int, size int, least long, piece long"), "pieces")
    shared = pieces.groupBy("least").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b").select("least")
    pieces_ = pieces
    pieces = B.keep(pieces.join(shared, "least"), "shared-pieces")
    B.forget(pieces_)

    # distinct pieces with their first document; a minimizer with more than one piece needs opening
    node = pieces.groupBy("least", "piece", "size").agg(F.min(F.struct("d", "tag", "pos")).alias("src"))
    many = node.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select("least", F.lit(True).alias("open"))
    node = B.keep(node.join(many, "least", "left").select("piece", "size", "src", F.coalesce("open", F.lit(False)).alias("open")), "nodes")

    # the windows of opened pieces, read at their source coordinates
    asked = node.where("open").groupBy(F.col("src.d").alias("d"), F.col("src.tag").alias("tag")).agg(F.collect_list(F.struct(F.col("src.pos").alias("pos"), "size", "piece")).alias("asked"))

    def open_(part: pa.RecordBatch):
        h, first = _words(part.column("text"))
        asked = part.column("asked")
        doc = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
        x = asked.flatten()
        pos, size, piece = (x.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        start = first[doc] + pos
        same = start + size + window - 1 <= first[doc + 1]
        doc, start, size, piece = doc[same], start[same], size[same], piece[same]
        same = B.signed(B.span_hashes(h, start, start + size + window - 1)) == piece
        doc, start, size, piece = doc[same], start[same], size[same], piece[same]
        off = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(start, size) + off
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(piece, size)), pa.array(off.astype(np.int32)), part.column("d").take(pa.array(np.repeat(doc, size))), pa.array(B.signed(B.span_hashes(h, at, at + window)))], ["piece", "off", "d", "edge"])

    edges = B.keep(B.arrow_map(keyed.join(asked, ["d", "tag"]), open_, "piece long, off int, d long, edge long"), "edges")
    seen = edges.groupBy("edge").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count("*").alias("n")).where("n > 1").select("edge", "a")
    # offsets whose window is in a document before the piece's own first one, or in several pieces
    opened = edges.join(seen, "edge").groupBy("piece").agg(F.collect_set(F.struct("off", "a")).alias("least"))

    # paths: neighbours of each piece in every document
    order = Window.partitionBy("d", "tag").orderBy("pos")
    p = pieces.join(node.select("piece", "open"), "piece")
    p = p.withColumn("after", F.when(F.lead("pos").over(order) == F.col("pos") + F.col("size"), F.lead("piece").over(order)))
    p = p.withColumn("before", F.when(F.lag("pos").over(order) + F.lag("size").over(order) == F.col("pos"), F.lag("piece").over(order)))
    p = B.keep(p.select("d", "tag", "pos", "size", "piece", "open", "before", "after"), "neighbours")
    only = lambda c: F.when((F.count("*") == F.count(c)) & (F.min(c) == F.max(c)), F.min(c))
    ends = p.where(~F.col("open")).groupBy("piece").agg(only("before").alias("before"), only("after").alias("after"))
    inner = ends.alias("x").join(ends.alias("y"), (F.col("x.before") == F.col("y.piece")) & (F.col("y.after") == F.col("x.piece"))).where(F.col("x.piece") != F.col("y.piece")).select(F.col("x.piece").alias("piece"), F.lit(1).alias("inner"))
    p = p.select("d", "tag", "pos", "size", "piece").join(inner, "piece", "left")
    p = p.withColumn("run", F.sum(F.when(F.col("inner").isNull(), 1).otherwise(0)).over(order))
    path = p.groupBy("d", "tag", "run").agg(F.min(F.struct("pos", "piece")).alias("head"), F.max(F.col("pos") + F.col("size")).alias("end"))
    path = path.select("d", "tag", F.col("head.pos").alias("pos"), F.col("head.piece").alias("piece"), "end")
    src = node.select("piece", F.col("src.d").alias("source"), "open")
    path = path.join(src, "piece").join(opened, "piece", "left")
    whole = path.where(~F.col("open") & (F.col("source") < F.col("d"))).select("d", "tag", F.col("pos").alias("start"), (F.col("end") + window - 1).alias("end"), "source")
    # an opened window: the least document over all pieces with it
    part = path.where("open").withColumn("w", F.explode_outer("least"))
    least = F.least("source", F.coalesce("w.a", F.lit(LAST)))
    own = path.where(F.col("open") & (F.col("source") < F.col("d"))).select("d", "tag", F.col("pos").alias("start"), (F.col("end") + window - 1).alias("end"), "source")
    part = part.where(F.col("w").isNotNull() & (F.col("w.a") < F.col("d")) & (F.col("source") >= F.col("d"))).select("d", "tag", (F.col("pos") + F.col("w.off")).alias("start"), (F.col("pos") + F.col("w.off") + window).alias("end"), least.alias("source"))
    return whole.unionByName(own).unionByName(part)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every row without the windows that an earlier document has."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("tag"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spans = find_spans(keyed, window).groupBy("d", "tag").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def strip(part: pa.RecordBatch):
        n, removed, kept = [], [], []
        for text, gone in zip(part.column("text").to_pylist(), part.column("gone")):
            words = text.encode().split()
            cover = None
            if gone.is_valid:
                g = gone.values
                mark = np.zeros(len(words) + 1, np.int32)
                np.add.at(mark, g.field(0).to_numpy(zero_copy_only=False), 1)
                np.add.at(mark, g.field(1).to_numpy(zero_copy_only=False), -1)
                cover = np.cumsum(mark[:-1]) == 0
                kept.append(b" ".join(compress(words, cover.tolist())).decode())
            else:
                kept.append(b" ".join(words).decode())
            n.append(len(words))
            removed.append(0 if cover is None else len(words) - int(cover.sum()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return B.arrow_map(keyed.join(spans, ["d", "tag"], "left").select("doc_id", "text", "gone"), strip, "doc_id long, n_words long, n_removed long, kept_text string")


def op8(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(B.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
