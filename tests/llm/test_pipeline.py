import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages_take_effect_and_account_for_every_document(spark, tmp_path):
    import corpus_pipeline
    from ctxloom.llm import lines, packing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(x.columns == columns for x in kept[:-1])
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in kept]
    assert all(a >= b for a, b in zip(ids, ids[1:])) and ids[-2] == ids[-1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [(i in ids[1], q) for i, q in labels.items()]
    assert sum(k == bool(q) for k, q in seen) / len(seen) > 0.97
    # no line of five words repeats after the line stage
    text = {r.doc_id: r.text for r in kept[2].collect()}
    n = [lines.normalised(x) for t in text.values() for x in (t or "").split("\n")]
    n = [x for x in n if len(x.split()) >= 5]
    assert len(n) == len(set(n))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    last = {r.doc_id: r.text for r in kept[4].collect()}
    assert not any(x in t for x in items for t in last.values())
    rows = kept[5].collect()
    assert {i: sum(r.length for r in rows if r.doc_id == i) for i in list(last)[:30]} == {i: len(last[i].split()) for i in list(last)[:30]}
    assert all(r.length <= r.padded_len <= packing.MAX_LEN for r in rows)
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, rows))
