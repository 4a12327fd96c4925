import numpy as np
from pyspark.sql import functions as F

from ctxloom.llm import hamming as H


def brute(rows, queries, k):
    out = []
    for q, c in queries:
        if c is not None:
            d = sorted((bin((c ^ x) & (1 << 64) - 1).count("1"), i is None, i or 0) for i, x in rows if x is not None)
            out += [(q, r + 1, None if n else i, x) for r, (x, n, i) in enumerate(d[:k])]
    return sorted(out, key=str)


def run(spark, rows, queries, k):
    a, b = (spark.createDataFrame([(*r, 1) for r in x], "id long, code long, dist int") for x in (rows, queries))
    return sorted((tuple(r) for r in H.search(a.repartition(3), b, k).select("query_id", "rank", "id", "distance").collect()), key=str)


def test_binary_code(spark):
    v = [[1.0, -1.0, 0.0, 2.0], [-1.0] * 63 + [1.0], None, [], [1.0] * 64 + [-3.0, 1.0]]
    df = spark.createDataFrame([(x,) for x in v], "v array<float>")
    got = [r.c for r in df.select(H.binary_code(F.col("v")).alias("c")).collect()]
    assert got == [9, -(1 << 63), None, 0, -2]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    code = lambda: int(rng.integers(-(1 << 63), (1 << 63) - 1))
    center = [code() for _ in range(4)]
    rows = [(i, code()) for i in range(150)]
    for i in range(150, 400):
        c = center[i % 4]
        for b in rng.integers(0, 63, int(rng.integers(0, 9))):
            c ^= 1 << int(b)
        rows.append((i, c))
    rows += [(500 + i, center[0]) for i in range(15)] + [(7, center[1]), (7, center[1]), (None, center[2]), (600, None)]
    queries = [r for r in rows if r[0] is None or r[0] % 20 == 0] + [(1000, 0), (1000, 0), (1001, None)]
    assert run(spark, rows, queries, 10) == brute(rows, queries, 10)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(1, 0), (2, 3), (3, -1)]
    assert run(spark, rows, [(9, 1)], 5) == brute(rows, [(9, 1)], 5)
    assert run(spark, [], [(9, 1)], 5) == [] and run(spark, rows, [], 5) == []
