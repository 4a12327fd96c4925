"""The minimal perfect hash and exact groups against plain grouping."""

import hashlib
import os
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import exact

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, row string, digest int, historical int"
EVEN = "doc_id % 2 = 0"


def norm(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def some(n, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (n, exact.DIGEST), dtype=np.uint8)


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_slots_are_a_permutation(n):
    keys = some(n)
    levels, rest, slots = exact.build(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert exact.slots_of(levels, rest, keys).tolist() == slots.tolist()
    assert sum(map(len, levels)) * 8 <= 5 * n + 300


def test_keys_that_never_part_are_kept_beside(monkeypatch):
    keys = some(50)
    keys[:, :16] = 7  # every level sends them to one place
    levels, rest, slots = exact.build(keys)
    assert len(rest) == 50 * exact.DIGEST and sorted(slots.tolist()) == list(range(50))
    assert exact.slots_of(levels, rest, keys).tolist() == slots.tolist()
    assert set(exact.slots_of(levels, rest, some(9, 2)).tolist()) == {-1}
    monkeypatch.setattr(exact, "LEVELS", 1)
    levels, rest, slots = exact.build(some(400))
    assert rest and exact.slots_of(levels, rest, some(400)).tolist() == slots.tolist()


def plain(rows):
    """Groups by text; of the largest id one row stays."""
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}


def odd_rows():
    turns = "".join("x" if bin(i).count("1") % 2 else "y" for i in range(1024))
    other = turns.translate(str.maketrans("xy", "yx"))
    rows = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "É"), (6, "é"), (7, turns), (9, other), (8, turns), (None, "A b"), (None, "alone"), (None, "alone"), (10, "twice"), (10, "Twice"), (12, "a b "), (14, "w " * 200_000), (15, "W " * 200_000)]
    return rows + [(k, "Hot") for k in range(100, 400)]


@pytest.mark.parametrize("historical", [EVEN, "true", "false", "cast(null as boolean)", "doc_id > 200"])
def test_groups(spark, historical, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_ROWS", 50)
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "r", 1, 2) for i, t in rows], SCHEMA)
    want = plain(rows)
    got = exact.groups(docs, F.expr(historical)).collect()
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(repr, ((i, *want[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)))
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(map(repr, kept)) == sorted(repr((keep, hashlib.sha256(t.encode()).hexdigest())) for t, (keep, _) in want.items())


def test_documents_that_stay_keep_their_columns(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, f"r{i}", 1, 2) for i, t in rows], SCHEMA)
    got = exact.without_repeats(docs, F.expr(EVEN))
    assert got.columns == docs.columns
    out = got.collect()
    assert sorted(map(repr, ((r.doc_id, norm(r.text), r.row) for r in out))) == sorted(repr((keep, t, f"r{keep}")) for t, (keep, _) in plain(rows).items())


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact.groups(docs, F.expr(EVEN)).collect() == [] and exact.without_repeats(docs, F.expr(EVEN)).collect() == []


def test_an_index_is_used_again(spark):
    """One index, two batches that come later."""
    rows = lambda r: spark.createDataFrame(r, "doc_id long, text string").select("doc_id", F.col("doc_id").alias("row"), exact.digest_of(F.col("text")).alias("digest"))
    index = exact.build_index(rows([(1, "a"), (2, "b"), (3, "A")]), 2)
    assert index.selectExpr("sum(n)").first()[0] == 2
    for batch, want in (([(5, "B"), (6, "c")], {(3, 2, True), (5, 2, True), (6, 1, False)}), ([], {(3, 2, True), (2, 1, True)})):
        got = exact.look_up(index, rows(batch) if batch else rows([(0, "x")]).limit(0), 2).collect()
        assert {(r.keep_id, r.group_size, r.in_history) for r in got} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = exact.op12(spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({exact.SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert any(not r.kept for r in df.collect())
