"""Nearest rows by matrices against sums of every pair, and the cells they are dealt into."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from ctxloom.operators import nearest, vectors


def total(kind, r, q):
    if r is None or q is None or len(r) != len(q) or None in r or None in q:
        return 0.0
    with np.errstate(all="ignore"):
        a, b = np.array(r, np.float64), np.array(q, np.float64)
        s = na = nb = np.float64(0.0)
        for x, y in zip(a, b):
            s, na, nb = s + ((x - y) ** 2 if kind == "l2" else x * y), na + x * x, nb + y * y
        n = np.sqrt(na) * np.sqrt(nb)
        s = 1 - s if kind == "l2" else s if kind == "ip" else np.float64(0.0) if n == 0 else s / n
    return float(s) if math.isfinite(s) else 0.0


def plain(rows, queries, order, k, kind):
    out = []
    for j, q in enumerate(queries):
        scores = [total(kind, r, q) for r in rows]
        near = sorted(range(len(rows)), key=lambda i: (-float(nearest.rounded(np.array([scores[i]]))[0]), -order[i]))
        out += [(j, i, scores[i]) for i in near[:k]]
    return sorted(out)


def vector(rng, size):
    kind = rng.randrange(8)
    one = [lambda: rng.choice([math.nan, math.inf, 1.0, None]), lambda: rng.choice([1e200, -1e200, 1e-170, 0.0]), lambda: 0.0, *[lambda: rng.randint(-2, 2) / 4] * 3, *[lambda: rng.gauss(0, 1)] * 2][kind]
    return rng.choice([None, [1.0] * (size + 1)]) if rng.random() < 0.1 else [one() for _ in range(size)]


@pytest.mark.parametrize("kind", ["ip", "l2", "cosine"])
def test_equals_the_sums_of_all_pairs(kind, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 13)
    monkeypatch.setattr(nearest, "QUERIES", 7)
    rng = random.Random(4)
    for case in range(60):
        size, k = rng.choice([0, 1, 3, 8]), rng.randint(1, 6)
        make = (lambda: vector(rng, size)) if case % 2 else lambda: [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(size)]
        rows, queries = [make() for _ in range(rng.randint(0, 60))], [make() for _ in range(rng.randint(0, 20))]
        order = rng.sample(range(1000), len(rows))
        kinds = pa.list_(pa.float64())
        i, j, s = nearest.best(pa.array(rows, kinds), pa.array(queries, kinds), np.array(order, np.int64), k, kind)
        assert sorted(zip(j.tolist(), i.tolist(), s.tolist())) == plain(rows, queries, order, k, kind), case


def test_rounding_is_by_decimal_digits():
    assert nearest.rounded(np.array([0.0000005, -0.0000005, 1.0000015, 2.5, 1e12 + 0.3, 0.1234564999999])).tolist() == [1e-6, -1e-6, 1.000002, 2.5, 1e12 + 0.3, 0.123456]


def test_no_pair_of_rows_leaves_a_cell(spark):
    """Every pair was a row of a join before; now only the best of a cell are rows."""
    rng = random.Random(6)
    rows = [(i, [rng.randint(-2, 2) / 2 for _ in range(3)]) for i in range(700)]
    frame, asked = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame(rows[:90], "query_id long, query array<float>")
    got = vectors.batch_knn(frame, asked, 4, block_bytes=4000)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Cross" not in plan
    want = plain([v for _, v in rows], [v for _, v in rows[:90]], list(range(700)), 4, "ip")
    assert sorted((r.query_id, r.vec_id, r.score) for r in got.collect()) == want


def test_within_a_group_and_by_the_smallest_name(spark):
    rows = [(f"d{i % 3}", f"u{i:02}", 2, [float(i % 2), 1.0]) for i in range(30)] + [("d9", "x", 2, [1.0, 1.0]), (None, "y", 2, [1.0, 1.0])]
    queries = [(q, f"d{q % 4}", 0.5, [1.0, 0.0]) for q in range(8)]
    frame = spark.createDataFrame(rows, "dir string, uri string, level int, embedding array<double>")
    asked = spark.createDataFrame(queries, "query_id long, dir string, above double, query array<double>")
    for size in (200, 1 << 20):
        out = nearest.nearest(frame, asked, 3, "ip", "uri", largest=False, within="dir", cell_bytes=size)
        assert out.columns == ["dir", "uri", "level", "query_id", "above", "score"]
        near = {}
        for r in out.collect():
            near.setdefault((r.query_id, r.dir), []).append((-r.score, r.uri))
        want = {}
        for q, d, _, _ in queries:
            if some := sorted((-v[0], u) for at, u, _, v in rows if at == d)[:3]:
                want[q, d] = some
        assert {k: sorted(v)[:3] for k, v in near.items()} == want
