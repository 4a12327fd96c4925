"""As-of joins, percentiles and dedupe chains by ranges, against plain loops; one key on all tasks."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.operators import ranges, usage
from ctxloom.plans.catalog import ORACLE, QUERIES
from ctxloom.sources import scratch

T0 = dt.datetime(2024, 1, 1)


def plain_as_of(left, right):
    out = []
    for k, at, x in left:
        some = [(t, v) for rk, t, v in right if k is not None and rk == k and t is not None and at is not None and v is not None and t <= at]
        out.append((k, at, x, max(some)[1] if some else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keys", [1, 7])
def test_as_of(spark, keys, monkeypatch):
    rng = random.Random(keys)
    left = [(rng.randrange(keys), rng.randrange(500), f"x{i}") for i in range(900)] + [(None, 5, "a"), (0, None, "b"), (0, -5, "c"), (99, 7, "d")] + [(0, 100, "same")] * 5
    right = [(rng.randrange(keys), rng.randrange(500), rng.randrange(9)) for _ in range(700)] + [(None, 1, 1), (0, None, 2), (0, 100, None), (0, 100, 8), (0, 100, 3)]
    parts = []
    real = scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: parts.append(real(df, name)) or parts[-1])
    a = spark.createDataFrame(left, "k long, at long, x string").repartition(5)
    b = spark.createDataFrame(right, "k long, at long, v long").repartition(5)
    got = ranges.as_of(a, b, "k", "at", "v")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_as_of(left, right)
    sizes = [r["count"] for r in parts[0].where("_key = 0").groupBy("_part").count().collect()]
    assert keys > 1 or len(sizes) == 4 and max(sizes) < 700  # one key lies on all tasks
    assert ranges.as_of(a.limit(0), b.limit(0), "k", "at", "v").collect() == []
    assert all(r.v is None for r in ranges.as_of(a, b.limit(0), "k", "at", "v").collect())


def test_as_of_in_small_batches(spark):
    left, right = [(1, i, "x") for i in range(0, 400, 3)], [(1, 5, 50), (1, 200, 7)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = ranges.as_of(spark.createDataFrame(left, "k long, at long, x string"), spark.createDataFrame(right, "k long, at long, v long"), "k", "at", "v").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, got), key=repr) == plain_as_of(left, right)


def test_percentiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), float(rng.choice([rng.randrange(50), rng.random() * 1e6]))) for _ in range(3000)] + [("one", 4.0), ("none", None), ("two", 1.0), ("two", 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.p for r in ranges.percentiles(df, ["k"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        v = [x for q, x in rows if q == k and x is not None]
        if v:
            want[k] = np.percentile(v, [0, 50, 95, 100]).tolist()
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    all_ = ranges.percentiles(df, [], "v", [0.25])
    assert all_.first().p == pytest.approx([np.percentile([v for _, v in rows if v is not None], 25)])
    assert ranges.percentiles(df.limit(0), [], "v", [0.25]).collect() == []
    plan = usage.latency(df.select(F.lit(200).alias("status_code"), F.col("v").alias("duration_ms")), [])._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def plain_chain(rows, seconds):
    keep, last = [], {}
    for k, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if k not in last or (t - last[k]).total_seconds() >= seconds:
            keep.append(i)
            last[k] = t
    return sorted(keep)


def test_chain_of_one_hot_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 1, 1, 2, None]), T0 + dt.timedelta(seconds=rng.randrange(40_000), milliseconds=rng.choice([0, 500])), i) for i in range(4000)] + [(1, None, 9001), (5, T0, 9002), (5, T0, 9003)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, event_id long")
    got = sorted(r.event_id for r in ranges.chain(df, "k", "ts", 45, "event_id").collect())
    assert got == plain_chain(rows, 45) and len(got) > 1000
    assert ranges.chain(df.limit(0), "k", "ts", 45, "event_id").collect() == []
    assert ranges.chain(df, "k", "ts", 0, "event_id").count() == 4002


def test_a_lock_hangs_by_turns_of_the_second(spark, tmp_path):
    """date_diff counts turns of the second: 23:49:59.9 is 601 of them before midnight, 600.1 seconds."""
    at = [dt.datetime(2024, 1, 30, 23, 49, 59, 0), dt.datetime(2024, 1, 30, 23, 49, 59, 900000), dt.datetime(2024, 1, 30, 23, 50), dt.datetime(2024, 1, 30, 23, 50, 0, 1), dt.datetime(2024, 2, 1), None]
    rows = [(i, t, i, "signup", 1.0, "{}") for i, t in enumerate(at)] + [(9, at[0], 9, "view", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(ORACLE["locks_hanging"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["locks_hanging"](spark, str(tmp_path)).collect()) == want == [(0,), (1,)]
