"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features of a text are its words (lower case, edge punctuation off) and their first four, five and
six bytes, so that inflected and compound forms share weights. A feature enters the model if it is
clearly commoner in toxic training documents (root of the log-likelihood ratio at least MIN_Z); its
value is log(1 + count). Labels say toxic or not; the severity grade of a toxic training document is how many of its words carry such a
feature: 1 up to the lower tercile of these counts, 2 up to the upper one, 3 beyond; other documents have grade 0.

P(grade >= k) = sigmoid(w.x - b_k) with one w for all thresholds and b_1 < b_2 < b_3. Outputs are
those probabilities, the expected severity (their sum) and toxic = P(grade >= 1) >= 0.5.

The fit reads a bounded sample (FIT_DOCS labelled documents that are not held out, half toxic where
there are enough) and keeps at most MAX_FEATURES features; scoring reads every whole text and
shuffles nothing. Null and empty texts have no features; each row gets its score. Texts of any length are read whole.
Ties: of features with one ratio those of the smaller hash enter first; P(grade >= 1) of exactly 0.5 is toxic. An empty table gives
no rows; without labels or clear features every text has the same score. Columns that are not asked for are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm import _base as B

FIT_DOCS = 12_000
MAX_FEATURES = 4096
GRADES = 3
#: Least root of the log-likelihood ratio and least number of toxic documents of a feature.
MIN_Z, MIN_DOCS = 5.0, 4
PREFIXES = (4, 5, 6)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes, text index, word index) of all words and prefixes."""
    raw, off = B.lower_bytes(col)
    starts, ends, first = B.word_spans(raw, off)
    starts, ends = B.edges_off(raw, starts, ends)
    doc = B.doc_of(first)
    word = np.arange(len(starts))
    full = starts < ends
    values = B._BYTE[raw]
    h, d, w = [B.span_hashes(values, starts[full], ends[full])], [doc[full]], [word[full]]
    for n in PREFIXES:
        some = ends - starts > n
        h.append(B.mix(B.span_hashes(values, starts[some], starts[some] + n) ^ np.uint64(n)))
        d.append(doc[some])
        w.append(word[some])
    return np.concatenate(h), np.concatenate(d), np.concatenate(w)


def _distinct(h, d):
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


@dataclass
class Model:
    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted feature hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.array([5.0, 6.0, 7.0]))

    def find(self, h):
        """(which hashes are features, their numbers)."""
        if not len(self.names):
            return np.zeros(len(h), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        hit = self.names[at] == h
        return hit, at[hit]

    def sparse(self, col: pa.Array):
        """(text, feature, value) of each active pair, and marker words of each text."""
        h, d, w = features(col)
        hit, f = self.find(h)
        d, w = d[hit], w[hit]
        pairs, n = np.unique(d * max(1, len(self.names)) + f, return_counts=True)
        words = np.unique(np.stack([d, w]), axis=1)[0] if len(d) else d
        return pairs // max(1, len(self.names)), pairs % max(1, len(self.names)), np.log1p(n), np.bincount(words, minlength=len(col))

    def at_least(self, d, f, v, n):
        """P(grade >= k) of n texts, a column for each k."""
        z = np.bincount(d, self.weights[f] * v, minlength=n) if len(d) else np.zeros(n)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -40, 40)))


def fit_ordinal(d, f, v, grade: np.ndarray, n_features: int, steps: int = 400, l2: float = 1e-4):
    """Shared weights and ordered cuts by Adam on the mean log-likelihood; cuts are a first one and positive gaps.

    Toxic and other documents weigh the same in total.
    """
    k = GRADES
    share = np.where(grade > 0, 0.5 / max(1, (grade > 0).sum()), 0.5 / max(1, (grade == 0).sum())) * len(grade)
    p = np.concatenate([np.zeros(n_features), [1.0], np.zeros(k - 1)])
    m, s = np.zeros(len(p)), np.zeros(len(p))
    n = len(grade)
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1:])
        cuts = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(d, w[f] * v, minlength=n)
        up = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -40, 40)))  # P(>= k)
        edge = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        prob = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))], axis=1)
        low, high = slope[np.arange(n), grade] / prob, slope[np.arange(n), grade + 1] / prob
        low, high = low * share, high * share
        gz = low - high  # d log p / d z
        gc = np.zeros(k + 2)
        np.add.at(gc, grade, -low)
        np.add.at(gc, grade + 1, high)
        gc = gc[1:-1]
        g = np.concatenate([np.bincount(f, gz[d] * v, minlength=n_features), [gc.sum()], [gc[i + 1:].sum() * gaps[i] for i in range(k - 1)]]) / n
        g[:n_features] -= 2 * l2 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        p = p + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1:]))])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = FIT_DOCS, max_features: int = MAX_FEATURES) -> Model:
    seen = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~B.held_out(F.col("doc_id")))
    draw = F.xxhash64(F.col("doc_id"), F.lit("toxic"))
    part = [seen.where(F.col("label") == k).orderBy(draw).limit(max_docs // 2) for k in (0, 1)]
    # at most max_docs ids: a bounded broadcast
    texts = B.keep(docs.select("doc_id", "text").join(F.broadcast(part[0].unionByName(part[1])), "doc_id"), "toxic-sample")
    size = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if len(size) < 2:
        return Model()

    def count(piece: pa.RecordBatch):
        h, d, _ = features(piece.column("text"))
        h, d = _distinct(h, d)
        toxic = piece.column("label").to_numpy(zero_copy_only=False)[d]
        names, of = np.unique(h, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(B.signed(names)), pa.array(np.bincount(of, toxic == 1, minlength=len(names)).astype(np.int64)), pa.array(np.bincount(of, toxic == 0, minlength=len(names)).astype(np.int64))], ["name", "yes", "no"])

    c = B.arrow_map(texts, count, "name long, yes long, no long").groupBy("name").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).where(F.col("yes") >= MIN_DOCS)
    yes, no, share = F.col("yes"), F.col("no"), size[1] / (size[0] + size[1])
    gain = yes * F.log(yes / ((yes + no) * share)) + F.when(no > 0, no * F.log(no / ((yes + no) * (1 - share)))).otherwise(0)
    z = F.when(yes > (yes + no) * share, F.sqrt(F.greatest(2 * gain, F.lit(0)))).otherwise(0)
    names = [r["name"] for r in c.withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "name").limit(max_features).collect()]
    if not names:
        return Model()
    model = Model(np.sort(np.array(names, np.int64).view(np.uint64)), np.zeros(len(names)))

    def active(piece: pa.RecordBatch):
        d, f, v, marks = model.sparse(piece.column("text"))
        at = np.searchsorted(d, np.arange(piece.num_rows + 1))
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), pa.array(marks.astype(np.int64)), pa.array([f[a:b].tolist() for a, b in zip(at, at[1:])], pa.list_(pa.int64())), pa.array([v[a:b].tolist() for a, b in zip(at, at[1:])], pa.list_(pa.float64()))], ["doc_id", "label", "marks", "f", "v"])

    rows = sorted(B.arrow_map(texts, active, "doc_id long, label int, marks long, f array<long>, v array<double>").collect(), key=lambda r: (r["doc_id"], r["marks"]))
    marks, label = np.array([r["marks"] for r in rows]), np.array([r["label"] for r in rows])
    some = marks[(label == 1) & (marks > 0)]
    low, high = np.quantile(some, [1 / 3, 2 / 3]) if len(some) else (1, 2)
    grade = np.where(label == 1, 1 + (marks > low) + (marks > high), 0)
    d = np.repeat(np.arange(len(rows)), [len(r["f"]) for r in rows])
    f = np.array([i for r in rows for i in r["f"]], np.int64)
    v = np.array([i for r in rows for i in r["v"]], float)
    model.weights, model.cuts = fit_ordinal(d, f, v, grade, len(names))
    B.forget(texts)
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, at_least_1..3, expected_severity and toxic of every row."""
    names, weights, cuts = model.names.tobytes(), model.weights.tobytes(), model.cuts.tobytes()

    def run(piece: pa.RecordBatch):
        m = Model(np.frombuffer(names, np.uint64), np.frombuffer(weights), np.frombuffer(cuts))
        d, f, v, _ = m.sparse(piece.column("text"))
        up = m.at_least(d, f, v, piece.num_rows)
        out = [piece.column(c) for c in keep] + [pa.array(up[:, k]) for k in range(GRADES)] + [pa.array(up.sum(axis=1)), pa.array((up[:, 0] >= 0.5).astype(np.int32))]
        return pa.RecordBatch.from_arrays(out, [*keep, *(f"at_least_{k + 1}" for k in range(GRADES)), "expected_severity", "toxic"])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in keep)
    return B.arrow_map(rows, run, f"{schema}, " + ", ".join(f"at_least_{k + 1} double" for k in range(GRADES)) + ", expected_severity double, toxic int")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, B.table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", B.held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
