import numpy as np
import pyarrow as pa
import pytest

from ctxloom.llm import decontam as D


def text(rng, n, vocab=60):
    return " ".join(f"w{int(i)}" for i in rng.zipf(1.4, n) % vocab)


def build(items):
    h = [D.words_of(pa.array([t]))[0] for _, t in items]
    df = {}
    for x in h:
        for t in np.unique(x).tolist():
            df[t] = df.get(t, 0) + 1
    return D.Index.build(items, df, len(items), float(np.mean([len(x) for x in h])), max(len(x) for x in h))


@pytest.mark.parametrize("cells", [1, 300, 4_000_000])
def test_wand_equals_exhaustive_scoring(cells, monkeypatch):
    monkeypatch.setattr(D, "REGION_CELLS", cells)
    rng = np.random.default_rng(0)
    items = [(i, text(rng, int(rng.integers(3, 40)))) for i in range(83)]
    index = build(items)
    assert index.bound.size <= max(cells, len(index.terms))
    for th in (0.2, 0.5, 0.8):
        n = 0
        for _ in range(60):
            t = np.unique(index.lookup(D.words_of(pa.array([text(rng, 50)]))[0]))
            t = t[t >= 0]
            want = {}
            for x in t:
                for k in range(index.first[x], index.first[x + 1]):
                    want[int(index.items[k])] = want.get(int(index.items[k]), 0) + index.impact[k]
            want = {i: s for i, s in want.items() if s >= th}
            regions = np.flatnonzero(index.bound[t].sum(axis=0) >= th)
            got = dict(index.search(t, regions, th))
            assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
            n += len(got)
        assert n or th > 0.7


def test_planted_items_are_found_and_others_left(spark):
    rng = np.random.default_rng(1)
    items = [(i, text(rng, 25, 5000) + ". " + text(rng, 9, 5000) + ".") for i in range(40)] + [(98, None), (99, ""), (7, text(rng, 12, 5000))]
    docs = [(i, text(rng, int(rng.integers(0, 400)), 5000)) for i in range(80)]
    planted = {(1000 + k, items[k][0], f"{text(rng, 90 * k, 5000)} {items[k][1].upper()} {text(rng, 30, 5000)}") for k in (0, 3, 17, 39, 42)}
    halves = [(2000, " ".join(items[5][1].split()[:18])), (2001, " ".join(items[6][1].split()[25:]))]
    rows = docs + [(d, t) for d, _, t in planted] + halves + [(None, items[2][1]), (3000, None), (3001, ""), (3002, items[1][1]), (3002, items[1][1])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in D.find(df, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == {(d, i) for d, i, _ in planted} | {(None, 2), (3002, 1)}


def test_many_shards_equal_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = [(i, text(rng, int(rng.integers(8, 60)), 300)) for i in range(50)]
    df = spark.createDataFrame([(k, text(rng, 40, 300) + " " + items[k][1]) for k in range(0, 50, 3)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, D.find(df, bench).collect()))
    monkeypatch.setattr(D, "SHARD_POSTINGS", 300)
    many = sorted(map(tuple, D.find(df, bench).collect()))
    assert len(one) == len(many) >= 17 and all(x[:4] == y[:4] and np.allclose(x[4:], y[4:]) for x, y in zip(one, many))


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.find(docs, bench).count() == 0
    assert D.find(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_items_with_edited_words_are_found(spark):
    rng = np.random.default_rng(3)
    item = lambda q, a: tuple([f"u{int(i)}" for i in rng.integers(0, 100_000, n)] for n in (q, a))
    pairs = [item(12, 6) for _ in range(20)] + [item(20, 10) for _ in range(20)]
    docs, filler = [], lambda n: " ".join(f"f{int(i)}" for i in rng.integers(0, 500, n))
    for k, (q, a) in enumerate(pairs):
        q, a = list(q), list(a)
        a[2] = "edited"
        q[5] = "changed"
        if k >= 20:
            a[6], q[12] = "edited", "typo"
        docs.append((k, f"{filler(30)} {' '.join(q)} {' '.join(a)} {filler(30)}"))
    halves = [(100 + k, f"{filler(20)} {' '.join(q)} {filler(10)}") for k, (q, _) in enumerate(pairs)]
    bench = spark.createDataFrame([(k, " ".join(q) + "\n" + " ".join(a)) for k, (q, a) in enumerate(pairs)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find(spark.createDataFrame(docs + halves, "doc_id long, text string"), bench).collect()}
    assert got == {(k, k) for k in range(40)}
    assert D.aligned(np.array([1, 2, 3, 4, 5]), np.array([9, 1, 2, 7, 4, 5, 9])) == 0.8


def test_stage_edges_case_and_column_names(spark, tmp_path):
    from ctxloom.llm import decontam

    item = "Où était le premier château de la ville ancienne en hiver\nÀ côté du grand ÉTANG près de la forêt"
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hidden = " ".join(f"((((«{w}" if k % 5 == 9 else f"[[[[{w}]]]]." for k, w in enumerate(item.upper().split()))
    docs = spark.createDataFrame([(1, "x y z " * 30 + hidden + " a b c", "k", 1), (2, "x y z " * 50, "k", 1), (3, None, "k", 1), (3, None, "k", 1), (4, "", "k", 1)], "doc_id long, text string, key string, _key int")
    out = decontam.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3, 3, 4]
    assert all(r.key == "k" and r._key == 1 for r in out.collect()) and decontam.stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("postings", [1_000_000, 250])
def test_find_equals_all_passages_against_all_items(spark, monkeypatch, postings):
    """Words of plain lower-case letters only, so that splitting and case need no second version here."""
    monkeypatch.setattr(D, "SHARD_POSTINGS", postings)
    rng = np.random.default_rng(8)
    items = {i: text(rng, int(rng.integers(6, 30)), 400) + "\n" + text(rng, int(rng.integers(2, 9)), 400) for i in range(40)}
    docs = {}
    for d in range(25):
        parts = [text(rng, int(rng.integers(0, 120)), 400)]
        for i in rng.integers(0, 40, int(rng.integers(0, 3))).tolist():
            w = items[i].split()
            w[int(rng.integers(0, len(w)))] = "typo"
            parts += [" ".join(w if rng.random() < 0.7 else w[: len(w) // 2]), text(rng, int(rng.integers(0, 90)), 400)]
        docs[d] = " ".join(parts)
    words = {i: t.split() for i, t in items.items()}
    mean, longest = np.mean([len(w) for w in words.values()]), max(len(w) for w in words.values())
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    impact = {}
    for i, w in words.items():
        x = {t: np.log1p((40 - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * (D.K1 + 1) / (w.count(t) + D.K1 * (1 - D.BIAS + D.BIAS * len(w) / mean)) for t in set(w)}
        impact[i] = {t: v / sum(x.values()) for t, v in x.items()}

    def share(part, passage):
        n = min(D.SHINGLE, len(part))
        grams = lambda w: {tuple(w[k: k + n]) for k in range(len(w) - n + 1)}
        cover = len(grams(part) & grams(passage)) / len(grams(part))
        row = [0] * (len(passage) + 1)
        for k, w in enumerate(part, 1):
            new = [k]
            for j, v in enumerate(passage, 1):
                new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
            row = new
        return cover if cover >= D.MIN_OVERLAP else max(cover, 1 - min(row) / len(part))

    step, want = max(longest, 32), {}
    for d, t in docs.items():
        w = t.split()
        for a in range(0, max(1, len(w) - step), step):
            passage = w[a: a + 2 * step]
            for i in items:
                score = sum(v for x, v in impact[i].items() if x in passage)
                if score >= D.THRESHOLD:
                    q, s = (share(p.split(), passage) for p in items[i].split("\n"))
                    if min(q, s) >= D.MIN_OVERLAP and (want.get((d, i)) is None or round(score, 9) > round(want[d, i][2], 9)):
                        want[d, i] = (a, a + len(passage), score, q, s)
    got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in D.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert set(got) == set(want) and len(want) > 8
    assert all(np.allclose(got[k], want[k]) for k in want)
