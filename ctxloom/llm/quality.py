"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of its characters and words and those of its two neighbours. Labels
exist per document only, so lines are labelled in rounds: all lines of a good document are good; in
a bad one, those lines are bad that the model of the round before calls bad, and the worst in any
case. Forward-backward marginals, weighted by line length, give a document's share of good text; a
logistic curve fitted on the training documents maps it to a score whose 0.7 mark is the best cut.

Fitting uses a bounded sample of labelled documents (FIT_DOCS, half of each class where there are
enough; chosen by a hash of the id); scoring reads every whole text once and shuffles nothing. A
null or empty text is one empty line. Rows repeat and ids may be null: each row gets its score. Texts of any length
are scored whole. A score of exactly the cut counts as good. An empty table gives no rows; where labels of one class are missing,
a model without weights scores by nothing but its constants. stage() passes columns of any name through.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm import _base as B

#: Most labelled documents that the model is fitted on.
FIT_DOCS = 6000
CUT = 0.7

_LOWER, _UPPER, _DIGIT, _SPACE, _END, _SYMBOL, _BANG, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = _LOWER
_CLASS[0x80:] = _LOWER
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _UPPER
_CLASS[list(b"0123456789")] = _DIGIT
_CLASS[list(b" \t\v\f\r\n")] = _SPACE
_CLASS[list(b".,;:?'\"()-")] = _END
_CLASS[list(b"#$%&*|<>{}[]\\~^=_+@/`")] = _SYMBOL
_CLASS[ord("!")] = _BANG
N_BASE = 16


def line_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, first line of each text (n + 1), bytes of each line)."""
    raw, off = B.text_bytes(col)
    n = len(raw)
    breaks = np.flatnonzero(raw == 10)
    # a text of k line feeds has k + 1 lines
    inner = np.searchsorted(off[1:], breaks, side="right")  # the text of each break
    first = np.concatenate([[0], np.cumsum(1 + np.bincount(inner, minlength=len(off) - 1))])
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    starts[is_first], starts[~is_first] = off[:-1], breaks + 1
    ends[is_last], ends[~is_last] = off[1:], breaks
    size = (ends - starts).astype(np.float64)
    kind = _CLASS[raw]
    share = np.empty((len(starts), 8))
    acc = np.zeros(n + 1, np.int32)
    for k in range(8):
        np.cumsum(kind == k, out=acc[1:])
        share[:, k] = acc[ends] - acc[starts]
    ws, we, _ = B.word_spans(raw, off)
    w0, w1 = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    words = (w1 - w0).astype(np.float64)
    line = np.repeat(np.arange(len(starts)), w1 - w0)
    h = B.word_hashes(raw, ws, we)
    again = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        np.cumsum((h[1:] == h[:-1]) & (line[1:] == line[:-1]), out=again[2:])
    repeats = (again[w1] - again[np.minimum(w0 + 1, w1)]).astype(np.float64)
    distinct = np.bincount(_first_of(h, line), minlength=len(starts)).astype(np.float64)
    at_end = np.where(size > 0, raw[np.maximum(ends - 1, 0)] if n else 0, 0)
    s, w = np.maximum(size, 1), np.maximum(words, 1)
    letters = share[:, _LOWER] + share[:, _UPPER]
    x = np.stack([
        share[:, _UPPER] / np.maximum(letters, 1), share[:, _DIGIT] / s, share[:, _SPACE] / s, share[:, _END] / s, np.sqrt(share[:, _SYMBOL] / s), np.sqrt(share[:, _BANG] / s),
        share[:, _OTHER] / s, letters / s, repeats / w, distinct / w, np.minimum((s - share[:, _SPACE]) / w, 40) / 10, np.log1p(words) / 4, np.isin(at_end, list(b".!?")), size == 0, np.sqrt(share[:, _SYMBOL] / w), np.minimum(distinct, 40) / 40,
    ], axis=1)
    return x, first, size


def _first_of(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The line of each distinct (line, word)."""
    order = np.lexsort((h, line))
    hs, ls = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])
    return ls[new]


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, the line's before and after, whether there are any, and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    top, end = np.zeros((len(x), 1)), np.zeros((len(x), 1))
    top[first[:-1]] = 1
    end[first[1:] - 1] = 1
    return np.concatenate([x, before, after, top, end, np.ones((len(x), 1))], axis=1)


def forward_backward(emit: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """Marginals of 'good', pair marginals summed, and the log-likelihood's normalisers, of all chains at once.

    emit: score of 'good' for each line ('bad' has 0). trans[a, b]: score of a before b.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    at = first[:-1][order]
    steps = int(n.max()) if len(n) else 0
    live = np.searchsorted(-n[order], -np.arange(steps), side="left")  # chains longer than t
    e = np.exp(trans - trans.max())
    shift = trans.max()
    total = int(first[-1])
    top = np.maximum(emit, 0)
    em = np.stack([np.exp(-top), np.exp(emit - top)], axis=1)
    alpha, beta, scale = np.zeros((total, 2)), np.ones((total, 2)), np.ones(total)
    for t in range(steps):
        i = at[: live[t]] + t
        a = em[i] if t == 0 else (alpha[i - 1] @ e) * em[i]
        scale[i] = a.sum(axis=1)
        alpha[i] = a / scale[i][:, None]
    for t in range(steps - 2, -1, -1):
        i = at[: live[t + 1]] + t
        beta[i] = ((beta[i + 1] * em[i + 1]) @ e.T) / scale[i + 1][:, None]
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    inner = np.ones(total, bool)
    inner[first[:-1][n > 0]] = False
    j = np.flatnonzero(inner)
    pair = (alpha[j - 1][:, :, None] * e[None] * (beta[j] * em[j])[:, None, :]) / scale[j][:, None, None] if len(j) else np.zeros((0, 2, 2))
    log_z = float((np.log(scale) + top).sum() + shift * len(j))
    return post[:, 1], pair.sum(axis=0), log_z


@dataclass
class Model:
    mean: list
    std: list
    weights: list
    trans: list
    slope: float = 1.0
    offset: float = 0.0

    def emissions(self, x, first):
        return ((with_neighbours(x, first) - np.array(self.mean)) / np.array(self.std)) @ np.array(self.weights)

    def good_share(self, x, first, size):
        good, _, _ = forward_backward(self.emissions(x, first), np.array(self.trans), first)
        w = np.maximum(size, 1)
        return np.add.reduceat(good * w, first[:-1]) / np.add.reduceat(w, first[:-1]) if len(first) > 1 else np.zeros(0)

    def score(self, col: pa.Array):
        share = self.good_share(*line_features(col))
        return 1 / (1 + np.exp(-np.clip(self.slope * share + self.offset, -60, 60)))


def _fit_crf(z: np.ndarray, y: np.ndarray, first: np.ndarray, weights: np.ndarray, trans: np.ndarray, rounds: int, l2: float):
    """Maximise the penalised conditional likelihood of line labels y by Adam."""
    m, v = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[j - 1], y[j]), 1)
    p = np.concatenate([weights, trans.ravel()])
    best, best_p = -np.inf, p
    for t in range(1, rounds + 1):
        w, tr = p[:-4], p[-4:].reshape(2, 2)
        emit = z @ w
        good, pair, log_z = forward_backward(emit, tr, first)
        ll = (float((emit * y).sum() + (seen * tr).sum()) - log_z) / len(y) - l2 * float(p @ p)
        if ll > best:
            best, best_p = ll, p
        g = np.concatenate([z.T @ (y - good), (seen - pair).ravel()]) / len(y) - 2 * l2 * p
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return best_p[:-4], best_p[-4:].reshape(2, 2)


def fit_lines(x: np.ndarray, first: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 3, steps: int = 120, l2: float = 1e-4) -> Model:
    """Fit from line features and document labels."""
    full = with_neighbours(x, first)
    mean, std = full.mean(axis=0), full.std(axis=0)
    mean[-1] = 0
    std[std < 1e-6] = 1
    z = (full - mean) / std
    of = np.repeat(np.arange(len(label)), np.diff(first))
    y = label[of].astype(np.int64)
    w, tr = np.zeros(z.shape[1]), np.zeros((2, 2))
    for r in range(rounds):
        w, tr = _fit_crf(z, y, first, w, tr, steps, l2)
        good, _, _ = forward_backward(z @ w, tr, first)
        if r + 1 < rounds:
            y = np.ones(len(y), np.int64)
            worst = np.minimum.reduceat(good, first[:-1])[of]
            y[(label[of] == 0) & ((good < 0.5) | (good <= worst))] = 0
    model = Model(mean.tolist(), std.tolist(), w.tolist(), tr.tolist())
    share = model.good_share(x, first, size)
    # the best cut in balanced accuracy, the middle of its range, becomes the 0.7 mark
    order = np.argsort(share)
    s, g = share[order], label[order]
    bad_below = np.concatenate([[0], np.cumsum(g == 0)]) / max(1, (g == 0).sum())
    good_above = 1 - np.concatenate([[0], np.cumsum(g == 1)]) / max(1, (g == 1).sum())
    edge = np.concatenate([[0.0], (s[1:] + s[:-1]) / 2, [1.0]])
    gain = bad_below + good_above
    cut = float(np.clip(np.mean(edge[gain >= gain.max() - 1e-9]), 0.02, 0.98))
    model.slope = 12.0
    model.offset = float(np.log(CUT / (1 - CUT)) - model.slope * cut)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = FIT_DOCS, label_col: str = "quality") -> Model:
    """Fit on at most max_docs labelled documents that are not held out."""
    seen = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~B.held_out(F.col("doc_id")))
    draw = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    part = [seen.where(F.col("label") == k).orderBy(draw).limit(max_docs // 2) for k in (0, 1)]
    some = part[0].unionByName(part[1])
    # at most max_docs ids: a bounded broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def run(piece: pa.RecordBatch):
        x, first, size = line_features(piece.column("text"))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array([a.astype("<f4").tobytes() for a in np.split(x, first[1:-1])]), pa.array([a.astype("<f8").tobytes() for a in np.split(size, first[1:-1])])], ["doc_id", "label", "x", "size"])

    rows = sorted(B.arrow_map(texts, run, "doc_id long, label int, x binary, size binary").collect(), key=lambda r: (r["doc_id"], r["x"]))
    if len({r["label"] for r in rows}) < 2:
        return Model([0.0] * (3 * N_BASE + 3), [1.0] * (3 * N_BASE + 3), [0.0] * (3 * N_BASE + 3), [[0.0, 0.0], [0.0, 0.0]], 12.0, -5.0)
    size = [np.frombuffer(r["size"], "<f8") for r in rows]
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, N_BASE) for r in rows]).astype(float)
    first = np.concatenate([[0], np.cumsum([len(s) for s in size])])
    return fit_lines(x, first, np.concatenate(size), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("quality_score", "quality_good")) -> DataFrame:
    """The columns in keep, and score and decision under names that no such column has, of every row."""
    said = json.dumps(model.__dict__)

    def run(piece: pa.RecordBatch):
        got = Model(**json.loads(said)).score(piece.column("text"))
        out = [piece.column(c) for c in keep] + [pa.array(got), pa.array((got >= CUT).astype(np.int32))]
        return pa.RecordBatch.from_arrays(out, [*keep, *names])

    rows = docs if "text" in docs.columns else docs.withColumn("text", F.lit(None).cast("string"))
    rows = rows.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keep)
    return B.arrow_map(rows, run, f"{schema}, `{names[0]}` double, `{names[1]}` int")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, B.table(spark, sf_dir, "labels"))
    s = score(docs.withColumn("held_out", B.held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
    return s.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.col("quality_good").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier calls bad go."""
    columns = docs.columns
    names = B.private(docs, "quality_score", "quality_good")
    model = fit(docs, B.table(spark, sf_dir, "labels"))
    return score(docs, model, columns, tuple(names)).where(F.col(names[1]) == 1).select(*columns)
