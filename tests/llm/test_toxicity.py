import zlib

import numpy as np
import pyarrow as pa

from ctxloom.llm import toxicity as T


def corpus(spark, n=600):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(60)]
        bad = i % 4 == 0
        for k in range(1 + i % 9 if bad else 0):
            words[5 * k] = "vile" + "".join(rng.choice(list("xyz"), 2)) + "."
        docs.append((i, " ".join(words), 1))
        labels.append((i, int(bad)))
    docs += [(None, None, 1), (0, "", 1), (1, "Vilexy", 1), (1, "Vilexy", 1), (n + 1, "x " * 60_000 + "vileyy", 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_features_by_hand():
    a, _, _ = T.features(pa.array(["Stupid!"]))
    b, d, w = T.features(pa.array(["x", None, "(stupid) stupidly"]))
    assert set(a) <= set(b[d == 2]) and set(d) == {0, 2} and len(set(w)) == 3


def test_gradient_reaches_ordered_cuts_and_shared_weights():
    rng = np.random.default_rng(2)
    v = rng.normal(size=3000)
    z = 2 * v + rng.logistic(size=3000)
    grade = (z > 0).astype(int) + (z > 1.5) + (z > 3)
    w, cuts = T.fit_ordinal(np.arange(3000), np.zeros(3000, int), v, grade, 1, steps=1500, l2=0)
    assert abs(w[0] - 2) < 0.3 and np.all(np.diff(cuts) > 0) and np.allclose(np.diff(cuts), 1.5, atol=0.35)


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(spark)
    model = T.fit(docs, labels)
    rows = T.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == 605
    for r in rows:
        assert 1 >= r.at_least_1 >= r.at_least_2 >= r.at_least_3 >= 0 and abs(r.at_least_1 + r.at_least_2 + r.at_least_3 - r.expected_severity) < 1e-9
    held = [r for r in rows if r.doc_id is not None and 1 < r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 80 and np.mean([r.toxic == int(r.doc_id % 4 == 0) for r in held]) > 0.97
    assert [r.toxic for r in rows if r.doc_id in (None, 601)] in ([0, 1], [1, 0])
    mild, severe = (np.mean([r.expected_severity for r in held if r.doc_id % 4 == 0 and r.doc_id % 9 in k]) for k in ((0, 1), (7, 8)))
    assert severe > mild


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark, 8)
    assert {r.toxic for r in T.score(docs, T.fit(docs, labels.limit(0)), ["doc_id"]).collect()} == {0}
    assert T.score(docs.limit(0), T.Model(), ["doc_id"]).count() == 0


def test_empty_tables_and_missing_labels(spark):
    from ctxloom.llm import toxicity

    docs = spark.createDataFrame([(1, "a line"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()
    assert len(got) == 2 and len({r.expected_severity for r in got}) == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0)), ["doc_id"]).collect() == []
