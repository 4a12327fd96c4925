import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ctxloom.llm import _base as B
from ctxloom.llm import minhash as M
from ctxloom.llm._links import components, link


def union(ids, edges):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (170, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 40)]
    want = union({x for e in edges for x in e if e[0] != e[1]}, edges)
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_link_finds_every_component_of_a_line_of_points(spark):
    # points on a line, linked up to distance 3: chains through members far from the first one
    rng = np.random.default_rng(3)
    at = {i: float(x) for i, x in enumerate(np.cumsum(rng.choice([1, 2, 3, 4], 300)))}
    order = rng.permutation(300).tolist()
    rows = [(b, i, order[i], 3.0) for b, ids in ((1, range(300)), (2, range(0, 300, 7)), (3, [5]), (4, [9, 250])) for i in ids]
    m = spark.createDataFrame(rows, "bucket long, id long, ord long, tol double")
    place = spark.createDataFrame(list(at.items()), "id long, x double")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        d = pairs.join(place.withColumnRenamed("id", "a").withColumnRenamed("x", "xa"), "a").join(place.withColumnRenamed("id", "b").withColumnRenamed("x", "xb"), "b")
        return d.select("a", "b", F.abs(F.col("xa") - F.col("xb")).alias("dist")).withColumn("ok", F.col("dist") <= 3)

    labels = link(m, verify, group=4)
    got = {r.id: r.label for r in labels.collect()}
    want = union(range(300), [(i, j) for i in range(300) for j in range(i) if abs(at[i] - at[j]) <= 3])
    assert {i: got.get(i, i) for i in range(300)} == want
    assert sum(asked) < 300 * 299 / 2 / 4


def test_link_of_sets_with_and_without_measured_distances(spark):
    # sets that drift apart by small steps, all in one bucket; a third of the distances is not measured
    rng = np.random.default_rng(5)
    sets, at = [], set(range(40))
    for i in range(160):
        if i % 8 == 0:
            at = set(rng.integers(0, 60, 45).tolist()) if rng.random() < 0.5 else set(range(i * 10, i * 10 + 40)) | set(range(10))
        at = (at - set(rng.choice(sorted(at), 2, replace=False).tolist())) | set(rng.integers(0, 2000, 2).tolist())
        sets.append(frozenset(at))
    order = rng.permutation(len(sets)).tolist()
    m = spark.createDataFrame([(1, i, order[i], 0.2, len(s)) for i, s in enumerate(sets)], "bucket long, id long, ord long, tol double, size long")
    held = spark.createDataFrame([(i, sorted(int(x) for x in s)) for i, s in enumerate(sets)], "id long, s array<int>")

    def verify(pairs):
        d = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
        far = 1 - F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
        return d.select("a", "b", F.when((F.col("a") + F.col("b")) % 3 > 0, far).alias("dist"), (far <= 0.2).alias("ok"))

    def features(ids):
        return held.join(ids, "id").select(F.explode(F.col("s").cast("array<long>")).alias("feature"), F.lit(1).cast("long").alias("n"), "id")

    got = {r.id: r.label for r in link(m, verify, group=4, features=features).collect()}
    want = union(range(len(sets)), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)])
    assert {i: got.get(i, i) for i in range(len(sets))} == want and 20 <= len(set(want.values())) < 140


def plain_alignment(a, b):
    """Edit distance by the textbook table."""
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        e = [i + 1]
        for j, y in enumerate(b):
            e.append(min(d[j] + (x != y), d[j + 1] + 1, e[j] + 1))
        d = e
    return d[-1]


def test_alignment(spark):
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 9, int(rng.integers(0, 40))) for _ in range(40)]
    b = [np.delete(np.insert(x, rng.integers(0, len(x) + 1, 2), 77), 0) for x in a]
    na, nb = (np.array([len(x) for x in y]) for y in (a, b))
    pa_, pb = np.full((40, na.max()), -1), np.full((40, nb.max()), -3)
    for i in range(40):
        pa_[i, : na[i]], pb[i, : nb[i]] = a[i], b[i]
    edits, m = M._align(pa_, pb, na, nb, 8)
    assert edits.tolist() == [plain_alignment(x.tolist(), y.tolist()) for x, y in zip(a, b)]
    edits, m = M._align(np.arange(20)[None], np.concatenate([np.arange(9), [99], np.arange(10, 20)])[None], np.array([20]), np.array([20]), 4)
    assert edits[0] == 1 and m[0] == 5 + 6  # runs of 9 and 10 words


def test_sketch_by_plain_code():
    t = pa.array(["a b c d e f g h", "x y", "a b c d e a b c d e a b c d e"])
    raw, off = B.text_bytes(t)
    s, e, first = B.word_spans(raw, off)
    g, begin = M.shingles(B.word_hashes(raw, s, e), first)
    assert begin.tolist() == [0, 4, 5, 16] and len(set(g.tolist())) == 15  # the texts share one; repeats have labels of their own
    assert M.sketch(g, begin).shape == (3, M.SKETCHES)


def similar(a, b):
    x, y = (collections.Counter(tuple(t[i: i + 5]) for i in range(max(1, len(t) - 4))) for t in (a.split(), b.split()))
    m = sum((x & y).values())
    return m / (sum(x.values()) + sum(y.values()) - m)


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    word = lambda: f"w{int(rng.integers(0, 3000))}"
    base = [[word() for _ in range(int(rng.integers(20, 200)))] for _ in range(25)]
    rows, n = [], 0
    for k, w in enumerate(base):
        for _ in range(12 if k < 5 else 3):
            c = list(w)
            for _ in range(int(rng.integers(0, 4))):
                c[int(rng.integers(0, len(c)))] = word()
            rows.append((n, ("  " if n % 3 else " ").join(c)))
            n += 1
    rows += [(900, None), (901, None), (902, ""), (903, "a b"), (904, "a  b"), (905, "b a"), (None, rows[0][1]), (906, "z " * 3000), (907, "z " * 3001), (908, rows[0][1]), (908, rows[0][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, label string, key0 int").repartition(5)
    got = M.classes(df.withColumn("key", B.row_key(F.col("doc_id"), F.col("text")))).collect()
    assert len(got) == len(rows)
    words = {i: (t or "").split() for i, t in enumerate(t for _, t in rows)}
    edges = [(i, j) for i in words for j in range(i) if words[i] and words[j] and (words[i] == words[j] or min(len(words[i]), len(words[j])) >= 5 and similar(rows[i][1], rows[j][1]) >= 0.8)]
    lab = union(range(len(rows)), edges)
    want = collections.defaultdict(set)
    for i, (d, _) in enumerate(rows):
        want[lab[i]].add(-1 if d is None else d)
    by = collections.defaultdict(set)
    for r in got:
        by[r.class_id if r.class_id is not None else -1].add(-1 if r.doc_id is None else r.doc_id)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))
    out = M.stage(spark, df, "")
    assert out.columns == df.columns and out.count() == len(want) and sorted(r.doc_id for r in out.collect()) == sorted(min(x for x in v if x >= 0) for v in want.values())


def test_empty(spark):
    assert M.classes(spark.createDataFrame([], "key long, doc_id long, text string")).count() == 0


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    one = "".join("zq"[bin(i).count("1") % 2] for i in range(2048))
    rows = [(1, one), (2, one.translate(str.maketrans("qz", "zq"))), (3, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in M.classes(df.withColumn("key", B.row_key(F.col("doc_id"), F.col("text")))).collect()}
    assert got[1] == got[3] and got[2] != got[1]


def test_known_links_are_not_gone_through_again(spark, monkeypatch):
    from ctxloom.llm import _links

    seen, plain = [], _links.components
    monkeypatch.setattr(_links, "components", lambda e: (seen.append(e.count()), plain(e))[1])
    m = spark.createDataFrame([(1, i, i, 0.5) for i in range(10)], "bucket long, id long, ord long, tol double")
    labels = _links.link(m, lambda pairs: pairs.withColumns({"dist": F.lit(0.0), "ok": F.lit(True)}))
    assert {tuple(r) for r in labels.select("id", "label").collect()} == {(i, 0) for i in range(10)}
    assert seen[0] == 9 and not any(seen[1:])


def test_links_to_first_members_are_joined_once(spark, monkeypatch):
    from ctxloom.llm import _links

    seen, plain = [], _links.components
    monkeypatch.setattr(_links, "components", lambda e: (seen.append(e.count()), plain(e))[1])
    # 20 meets 10 in one bucket and 0 in the other: the second comparison joins what the first one found
    m = spark.createDataFrame([(1, i, i, 0.5) for i in range(10)] + [(b, i, i, 0.5) for b in (2, 3) for i in range(10, 21)] + [(4, 0, 0, 0.5), (4, 20, 20, 0.5)], "bucket long, id long, ord long, tol double")
    labels = _links.link(m, lambda pairs: pairs.withColumns({"dist": F.lit(0.0), "ok": F.lit(True)}))
    assert {tuple(r) for r in labels.select("id", "label").collect()} == {(i, 0) for i in range(21)}
    assert seen == [9 + 10 + 1]


def test_alignment_of_pairs_of_any_lengths():
    rng = np.random.default_rng(4)
    a = [rng.integers(0, 5, n) for n in (0, 0, 1, 3, 40, 40, 39, 7)]
    b = [rng.integers(0, 5, n) for n in (0, 4, 1, 0, 36, 44, 39, 9)]
    na, nb = (np.array([len(x) for x in y]) for y in (a, b))
    x, y = np.full((8, na.max()), -1), np.full((8, nb.max()), -3)
    for i in range(8):
        x[i, : na[i]], y[i, : nb[i]] = a[i], b[i]
    edits, m = M._align(x, y, na, nb, 60)
    assert edits.tolist() == [plain_alignment(s.tolist(), t.tolist()) for s, t in zip(a, b)]
    for i in range(8):  # each pair alone gives the same
        e, k = M._align(x[i: i + 1, : na[i]], y[i: i + 1, : nb[i]], na[i: i + 1], nb[i: i + 1], 60)
        assert (e[0], k[0]) == (edits[i], m[i])
