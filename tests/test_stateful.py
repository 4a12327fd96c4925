"""Streams with state against plain loops: many batches, restarts, versions in any batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ctxloom.streaming import stateful
from ctxloom.streaming import stream as ST

T0 = dt.datetime(2024, 1, 1)


def test_expiry_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((T0 + dt.timedelta(seconds=rng.randrange(90_000)), rng.randrange(12), i) for i in range(600))
    rows = [(k, i, at, None if k == 3 else at + dt.timedelta(seconds=rng.choice([60, 600, 4000]))) for at, k, i in rows]
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    own = stateful.stateful_session(spark)
    for n in range(0, 600, 150):  # each folder of files is read by a run of its own, from the same checkpoint
        part = spark.createDataFrame(rows[n: n + 150], "k long, i long, at timestamp, until timestamp")
        part.coalesce(1).write.mode("append").parquet(src)
        ST.once(stateful.expirations(ST.source(own, src, 1), "k", "i", "at", "until", "10 minutes"), out, mark)
    got = sorted((r.k, r.i) for r in spark.read.parquet(out).collect())
    later, want = {}, []
    end = max(r[2] for r in rows) - dt.timedelta(minutes=10)
    for k, i, _at, until in reversed(rows):
        if until is not None and (later[k] >= until if k in later else until <= end):
            want.append((k, i))
        later[k] = _at
    assert got == sorted(want) and 50 < len(got) < 600
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or "")


def test_countdown_over_batches_and_restarts(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    own = stateful.stateful_session(spark)
    batches = [
        [("a", 1, 3), ("a", 2, None), ("b", 3, 2), ("c", 4, 0), ("d", 5, None), (None, 6, 1)],
        [("a", 7, None), ("b", 8, None), ("d", 9, 1), ("e", 10, 2), ("e", 11, None), ("e", 12, 2)],
        [("a", 13, None), ("a", 14, None), ("d", 15, None), ("e", 16, None)],
    ]
    done = []
    for part in batches:
        spark.createDataFrame(part, "task string, seq long, total long").coalesce(1).write.mode("append").parquet(src)
        ST.once(stateful.completions(ST.source(own, src, 1), "task", "seq", "total"), out, mark)
        done.append(sorted(tuple(r) for r in spark.read.schema("task string, total long").parquet(out).collect()))
    assert done == [[("c", 0)], [("c", 0)], [("a", 3), ("c", 0), ("d", 1)]]
