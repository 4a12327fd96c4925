"""Exact whitening against plain integer arithmetic."""

import math
import os
from fractions import Fraction

import numpy as np
import pytest

from ctxloom.llm import whitening as w

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, x int, component string"


def plain(rows):
    """(ids, integer vectors, n, sums, covariance as fractions) by loops."""
    good = [(i, [max(-(2**63), min(2**63 - 1, math.floor(256 * float(np.float32(c))))) for c in e]) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    sizes = [len(x) for _, x in good]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), d))
    good = [(i, x) for i, x in good if len(x) == dims]
    fit = sorted(set(tuple(x) for _, x in good))
    n = len(fit)
    sums = [sum(x[j] for x in fit) for j in range(dims)]
    cov = [[Fraction(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j], n * n) for j in range(dims)] for i in range(dims)]
    return good, fit, n, sums, cov


def compare(rows, got, close=1e-6):
    good, fit, n, sums, cov = plain(rows)
    dims = len(sums)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == len(good) * min(4, dims)
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(sum(cov[i][i] for i in range(dims)))
    flip = {}
    for i, x in good:
        for r in (r for r in by[i] if str(r.deviation_text) == str(sum((n * x[j] - sums[j]) ** 2 for j in range(dims)))):
            assert r.n == n and r.deviation == (int(r.deviation_text) if int(r.deviation_text) < 2**63 else None)
            k = r.component - 1
            assert r.explained == pytest.approx(values[k] / trace if trace else 0.0, rel=1e-9, abs=1e-12)
            assert r.identity_error <= 1e-4
        mine = [r for r in by[i] if r.deviation_text == str(sum((n * x[j] - sums[j]) ** 2 for j in range(dims)))]
        assert {r.component for r in mine} == set(range(1, min(4, dims) + 1))
        for r in mine:
            k = r.component - 1
            if values[k] <= values[0] * dims * 2.3e-16:
                assert r.whitened is None
                continue
            want = sum(float(Fraction(n * x[j] - sums[j], n)) * vectors[j, k] for j in range(dims)) / math.sqrt(values[k])
            if k not in flip and abs(want) > 0.01:
                flip[k] = math.copysign(1, want * r.whitened)
            assert abs(r.whitened * flip.get(k, 1) - want) < close or k not in flip
    return values


def test_query_equals_plain_arithmetic(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(rows, w.op11(spark, SF).collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    scale = np.array([4.0, 3.0, 2.0, 1.0, 0.5])
    rows = [(i, (rng.normal(size=5) * scale).tolist()) for i in range(300)]
    rows += [(900 + i, rows[7][1]) for i in range(200)]  # one vector fills much of the table
    rows += [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0]), (2003, [1.0, math.nan, 1.0, 1.0, 1.0]), (2004, [math.inf] * 5), (2005, [-math.inf, 0.0, 0.0, 0.0, 0.0]), (2006, [1.0, 2.0]), (2007, [-0.0] * 5)]
    docs = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)
    got = w.whiten(docs).collect()
    compare(rows, got)
    assert not {2000, 2001, 2002, 2003, 2004, 2005, 2006} & {r.vec_id for r in got} and 2007 in {r.vec_id for r in got}
    assert w.whiten(docs.limit(0)).collect() == []
    twice = w.whiten(docs.where("vec_id < 300").unionAll(docs.where("vec_id < 300"))).collect()
    assert len(twice) == 2400 and {r.n for r in twice} == {300}
    nulls = w.whiten(docs.where("vec_id < 300").selectExpr("cast(null as long) vec_id", "embedding")).collect()
    assert len(nulls) == 1200


def test_huge_entries_and_no_variance(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(rng.normal() * 1e16)), float(np.float32(rng.normal() * 1e12)), float(np.float32(rng.normal()))]) for i in range(60)] + [(99, [3e38, -3e38, 0.0])]
    got = w.whiten(spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)).collect()
    compare(rows, got)
    assert any(r.deviation is None for r in got)
    one = w.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "x"), (2, [1.0, 2.0], 1, "x")], SCHEMA)).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 1 for r in one)
    flat = w.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 1, "x") for i in range(20)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat)


def test_scatter_is_exact_at_every_size():
    rng = np.random.default_rng(1)
    for top in (3, 2**15, 2**31, 2**61, 2**63 - 1):
        x = rng.integers(-top, top, (50, 3), dtype=np.int64)
        shift = [int(v) for v in x[0]]
        sums, products = w.scatter(x, shift)
        d = [[int(v) - s for v, s in zip(row, shift)] for row in x]
        assert sums.tolist() == [sum(r[j] for r in d) for j in range(3)]
        assert products.tolist() == [[sum(r[i] * r[j] for r in d) for j in range(3)] for i in range(3)]
        for v in (*sums, *products.ravel()):
            assert sum(p << (32 * k) for k, p in w.pieces(v)) == v


def test_squares_are_exact_at_every_size():
    rng = np.random.default_rng(2)
    for top in (5, 2**30, 2**40, 2**61):
        q = rng.integers(-top, top, (40, 7), dtype=np.int64)
        q[0] = -top
        assert w.square_sums(q) == [sum(int(v) ** 2 for v in row) for row in q]
