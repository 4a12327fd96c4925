import itertools
import zlib

import numpy as np
import pyarrow as pa

from ctxloom.llm import quality as Q


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 1, 4, 9, 10])
    emit, trans = rng.normal(size=10) * 2, rng.normal(size=(2, 2))
    good, pair, log_z = Q.forward_backward(emit, trans, first)
    want, want_pair, want_z = np.zeros(10), np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        total, marg, prs = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            p = np.exp(sum(emit[a + i] for i, v in enumerate(y) if v) + sum(trans[u, v] for u, v in zip(y, y[1:])))
            total += p
            marg += p * np.array(y)
            for u, v in zip(y, y[1:]):
                prs[u, v] += p
        want[a:b] = marg / total
        want_pair += prs / total
        want_z += np.log(total)
    assert np.allclose(good, want) and np.allclose(pair, want_pair) and np.isclose(log_z, want_z)


def test_line_features_by_hand():
    x, first, size = Q.line_features(pa.array(["Ab ab ab !\n\n12 <<", None, "", "é"]))
    assert first.tolist() == [0, 3, 4, 5, 6] and size.tolist() == [10, 0, 5, 0, 0, 2]
    assert np.isclose(x[0, 0], 1 / 6) and np.isclose(x[0, 8], 1 / 4) and np.isclose(x[0, 9], 3 / 4) and x[0, 12] == 1
    assert np.isclose(x[2, 1], 2 / 5) and x[1, 13] == 1 and np.isclose(x[5, 7], 1)
    n = Q.with_neighbours(x, first)
    k = Q.N_BASE
    assert np.allclose(n[1, k:2 * k], x[0]) and np.allclose(n[1, 2 * k:3 * k], x[2]) and not n[0, k:2 * k].any() and not n[2, 2 * k:3 * k].any()


def corpus(spark, n=400):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    docs, labels = [], []
    for i in range(n):
        lines = [" ".join(word() for _ in range(12)) + "." for _ in range(4)]
        bad = i % 3 == 0
        if bad:
            lines[1:] = [" ".join([word()] * 15) for _ in range(3)]
        docs.append((i, "\n".join(lines), 5.0))
        labels.append((i, int(not bad)))
    docs += [(None, None, 1.0), (3, "", 1.0), (3, "", 1.0), (n + 7, "x " * 50_000, 1.0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(spark)
    model = Q.fit(docs, labels)
    rows = Q.score(docs, model, ["doc_id", "score"]).collect()
    assert len(rows) == 404 and all(0 <= r.quality_score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and 3 < r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 50 and all(r.quality_good == int(r.doc_id % 3 != 0) for r in held)


def test_no_labels_and_no_documents(spark):
    docs, labels = corpus(spark, 4)
    model = Q.fit(docs, labels.limit(0))
    assert Q.score(docs, model, ["doc_id"]).count() == 8
    assert Q.score(docs.limit(0), model, ["doc_id"]).count() == 0


def test_stage_keeps_good_rows_whole(spark, tmp_path):
    docs, labels = corpus(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = Q.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert all((i in kept) == (i % 3 != 0) for i in range(4, 400))


def test_stage_keeps_columns_of_any_name(spark, tmp_path):
    from ctxloom.llm import quality

    rows = [(i, ("good line of words here. " if i % 2 else "BUY!!! $$$ 999 ") * 5, 7, 0.5) for i in range(12)] + [(20, None, 7, 0.5), (20, None, 7, 0.5), (21, "", 7, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_good int, quality_score double")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and all(r.quality_good == 7 and r.quality_score == 0.5 for r in out.collect())
    assert quality.stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_empty_tables_and_missing_classes(spark):
    from ctxloom.llm import quality

    docs = spark.createDataFrame([(1, "a line"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model, ["doc_id"]).collect()
    assert len(got) == 2 and all(0 <= r.quality_score <= 1 for r in got)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels.limit(0)), ["doc_id"]).collect() == []
