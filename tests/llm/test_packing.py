import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxloom.llm import packing
from pyspark.sql import functions as F


def padding(counts, limits):
    return sum(c * (min(x for x in limits if x >= n) - n) for n, c in enumerate(counts) if c)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 4))
def test_limits_are_optimal(counts, buckets):
    got = packing.best_limits(np.array(counts), buckets)
    present = [n for n, c in enumerate(counts) if c]
    if not present:
        assert got == []
        return
    best = min(padding(counts, [*x, present[-1]]) for k in range(min(buckets, len(present))) for x in itertools.combinations(present[:-1], k))
    assert len(got) <= buckets and got[-1] == present[-1] and padding(counts, got) == best


def test_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" * int(n))) for i, n in enumerate(rng.integers(0, 70, 300))] + [(None, None), (5, "a b"), (5, "a b"), (7, "x " * 333), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = packing.pack(packing.sequences(df, packing.n_words(F.col("text")), 50), 50, 4, 120).collect()
    want = []
    for i, t in rows:
        n = len((t or "").split())
        want += [(i, k, 50 * k, min(50, n - 50 * k)) for k in range(max(1, -(-n // 50)))]
    assert sorted(map(str, [(r.doc_id, r.chunk, r.start, r.length) for r in out])) == sorted(map(str, want))
    counts = np.bincount([r.length for r in out], minlength=51)
    limits = packing.best_limits(counts, 4)
    for b, limit in enumerate(limits):
        rs = sorted((r for r in out if r.bucket == b), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.chunk))
        per = 120 // max(1, limit)
        assert all(r.padded_len == limit and r.length <= limit for r in rs)
        places = sorted((r.batch, r.slot) for r in rs)
        assert places == [(i // per, i % per) for i in range(len(rs))]
        assert [(r.batch, r.slot) for r in sorted(rs, key=lambda r: (r.batch, r.slot))] == places
        ids = [(r.doc_id is not None, r.doc_id or 0, r.chunk) for r in sorted(rs, key=lambda r: (r.batch, r.slot))]
        assert ids == sorted(ids)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.sequences(df, packing.n_words(F.col("text")))).count() == 0


def test_stage_with_odd_rows_and_clashing_columns(spark):
    from ctxloom.llm import packing as P

    rows = [(1, "a b c", "x", 5), (1, "a b c", "x", 5), (1, "other words of that id", "y", 6), (None, "no id", None, None), (2, None, "z", 7), (3, "", "z", 7), (4, "w " * 5000, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, length int")
    got = P.stage(spark, docs, "").collect()
    total = {}
    for r in got:
        total.setdefault(r.doc_id, []).append(r.length)
    assert {k: sum(v) for k, v in total.items()} == {1: 3 + 3 + 5, None: 2, 2: 0, 3: 0, 4: 5000}
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got) and all(r.length <= r.padded_len for r in got)
    assert P.stage(spark, docs.limit(0), "").collect() == []
