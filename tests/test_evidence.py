"""Items in documents against plain containment."""

import random

from ctxloom.operators import fsq


def test_items_of_every_length(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    docs = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(120)] + ["", None, "same", "same"]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(100, docs[3]), (101, docs[3]), (102, docs[3][2:-1]), (103, ""), (104, None), (105, "zzz"), (106, "same")]
    d = spark.createDataFrame([(i % 50, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    want = {i: n for i, t in items if t is not None and (n := sum(x is not None and t in x for x in docs))}
    for size in (200, 1 << 20):
        assert {r.item_id: r.docs for r in fsq.evidence(d, it, size).collect()} == want
    assert fsq.evidence(d, it.limit(0)).collect() == [] and fsq.evidence(d.limit(0), it).collect() == []
