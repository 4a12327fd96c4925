import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ctxloom.llm import _base as B
from ctxloom.llm import lines as L


def plain(line):
    """The stated normal form, character by character."""
    out = []
    for c in line.lower():
        out.append("0" if c in "0123456789" else c if unicodedata.category(c)[0] in "LMN" else " ")
    return " ".join("".join(out).split(" ")).split()


def groups(rows):
    """Groups of (doc, line, row, words) whose lines are equal or, from five words, at edit similarity 0.8: all pairs, by another engine."""
    at = []
    for r, (d, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            if plain(line):
                at.append((((1 << 63) - 1 if d is None else d), k, r, plain(line)))
    con = duckdb.connect()
    # that engine's distance counts bytes: a letter of two bytes gives way to one that no line has
    con.register("l", pa.table({"i": list(range(len(at))), "t": [" ".join(x[3]).replace("é", "~") for x in at], "n": [len(x[3]) for x in at]}))
    pairs = con.sql("""SELECT a.i, b.i FROM l a JOIN l b ON a.i < b.i AND (a.t = b.t OR a.n >= 5 AND b.n >= 5
        AND 5 * abs(length(a.t) - length(b.t)) <= greatest(length(a.t), length(b.t))
        AND 5 * levenshtein(a.t, b.t) <= greatest(length(a.t), length(b.t)))""").fetchall()
    up = list(range(len(at)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        up[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for i, x in enumerate(at):
        out.setdefault(find(i), []).append(x)
    return list(out.values())


def keyed(df):
    return df.withColumn("key", B.row_key(F.col("doc_id"), F.col("text")))


def removed(spark, rows):
    df = keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    return {(r.doc_id, r.line) for r in L.duplicate_lines(df).join(df, "key").select("doc_id", "line").collect()}


def test_normalised_and_line_table():
    assert L.normalised("  Héllo,  World 2024! ") == "héllo world 0000"
    assert L.normalised("École ÜBER «x» – y…") == "école über x y"
    for text in ("Straße №7 — ÀÉÎ’s naïve\tco-op", "“Quoted”¡ya! é́ 東京、です", "a\r\x0b\x0cb"):
        assert L.normalised(text).split() == plain(text)
    t = pa.array([None, "one two three four five\n\nA b c d\nsix 7 eight nine ten.", "", "x\n", "a b c d e"])
    doc, number, h, n = L.line_table(t)
    assert doc.tolist() == [1, 1, 1, 3, 4] and number.tolist() == [0, 2, 3, 0, 0] and n.tolist() == [5, 4, 5, 1, 5]
    assert L.line_table(pa.array(["SIX 1 eight, nine ten"]))[2][0] == h[2]


def test_simhash_by_plain_code():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 62, 1400, dtype=np.int64).astype(np.uint64) * np.uint64(3)
    start = np.array([0, 1, 8, 700])
    got = L.simhash(h, start).tolist()
    for a, b, g in zip(start, [1, 8, 700, 1400], got):
        want = sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in h[a:b]) > b - a)
        assert want == g


def test_distance_by_plain_code():
    rng = np.random.default_rng(3)
    for _ in range(400):
        a = "".join(rng.choice(list("abé東"), int(rng.integers(0, 30))))
        b = a if rng.random() < 0.1 else "".join(rng.choice(list("abé東"), int(rng.integers(0, 30)))) if rng.random() < 0.5 else a[:7] + "xy" + a[9:]
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j] + (x != y), d[j + 1] + 1, e[j] + 1))
            d = e
        most = int(rng.integers(0, 20))
        got = L.distance(a, b, most)
        assert d[-1] <= got <= most if d[-1] <= most else got > most


def edited(rng, word, w):
    """One of the edits that a reader would still call the same line."""
    w, at = list(w), int(rng.integers(0, len(w)))
    kind = int(rng.integers(0, 6))
    if kind == 0:
        w[at] = word()
    elif kind == 1:
        p = int(rng.integers(0, len(w[at]) + 1))
        w[at] = w[at][:p] + "q" + w[at][p:]
    elif kind == 2:
        del w[at]
    elif kind == 3:
        w.insert(at, word())
    elif kind == 4:
        for i in rng.choice(len(w), max(1, len(w) // 8), replace=False):
            w[int(i)] = word()
    else:
        w = [x[:-1] if len(x) > 3 and rng.random() < 0.1 else x for x in w]
    return w


def test_recall_and_no_false_removal(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwé"), int(rng.integers(2, 9))))
    rows = []
    for lo, hi in ((5, 9), (9, 16), (16, 41), (41, 70)):
        for _ in range(45):
            w = [word() for _ in range(int(rng.integers(lo, hi)))]
            for v in (w, edited(rng, word, w), edited(rng, word, w)):
                rows.append((len(rows), " ".join(v).capitalize() + "."))
    got, want = removed(spark, rows), set()
    for g in groups(rows):
        want |= {x[:2] for x in sorted(g)[1:]}
    assert got <= want and len(want) >= 300
    for lo, hi in ((0, 9), (9, 16), (16, 41), (41, 999)):
        some = {(d, k) for d, k in want if lo <= len(rows[d][1].split()) < hi}
        recall = len(got & some) / len(some)
        print(f"recall of lines of {lo} to {hi - 1} words: {recall:.3f} of {len(some)}")
        assert len(some) >= 40 and recall >= 0.9


def test_stage_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijkl"), int(rng.integers(2, 9))))
    pool = [" ".join(word() for _ in range(int(rng.integers(3, 40)))) for _ in range(30)]
    rows = []
    for d in range(50):
        t = []
        for _ in range(int(rng.integers(1, 7))):
            w = pool[int(rng.integers(0, 30))].split() if rng.random() < 0.5 else [word() for _ in range(int(rng.integers(3, 30)))]
            if rng.random() < 0.5:
                w[int(rng.integers(0, len(w)))] += "x"
            t.append(" ".join(w).capitalize() + ".")
        rows.append((d, "\n".join(t)))
    rows += [(60, None), (61, ""), (62, "\n\n"), (None, pool[0]), (63, "q w e r t " * 4000), (64, "q w e r t " * 4000 + "y"), (65, "word " * 12), (66, "other " * 12), (67, "Word  " * 12)]
    df = spark.createDataFrame([(*r, 3, "z", 7, 1) for r in rows], "doc_id long, text string, line int, hash string, key long, gone int").repartition(4)
    want, fuzzy = set(), 0
    for g in groups([r for r in rows if r[0] not in (63, 64)]):
        g.sort()
        want |= {x[:2] for x in g[1:]}
        fuzzy += len({tuple(x[3]) for x in g}) > 1
    want = {((None if d == (1 << 63) - 1 else d), k) for d, k in want} | {(64, 0)}
    assert fuzzy >= 2 and removed(spark, rows) == want
    out = L.stage(spark, df, "")
    assert out.columns == df.columns
    out = out.collect()
    for r in out:
        whole = dict(rows)[r.doc_id]
        kept = [x for k, x in enumerate((whole or "").split("\n")) if (r.doc_id, k) not in want]
        assert (r.text or "") == "\n".join(kept) and (r.line, r.hash, r.key, r.gone) == (3, "z", 7, 1)
    gone = [d for d, t in rows if t and "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in want).strip() == "" and any((d, k) in want for k in range(t.count("\n") + 1))]
    assert len(out) == len(rows) - len(gone)


def test_equal_rows_and_empty(spark):
    t = "one two three four five six"
    df = keyed(spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string"))
    # equal rows are one row with one key: neither loses its line to the other
    assert [(r.key, r.line) for r in L.duplicate_lines(df).collect()] == [(df.where("doc_id = 2").first().key, 0)]
    assert L.duplicate_lines(df.limit(0)).count() == 0 and L.stage(spark, df.limit(0), "").count() == 0


def test_equal_short_lines_go_and_different_ones_stay(spark):
    rows = [(1, "Chapter one\n\n..."), (2, "chapter ONE.\nchapter two\n\n..."), (3, "word"), (4, "Word!\nchapter one"), (5, "words"), (6, "ÉTÉ 1"), (7, "été 2")]
    assert removed(spark, rows) == {(2, 0), (4, 0), (4, 1), (7, 0)}


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    one = "".join("zq"[bin(i).count("1") % 2] for i in range(2048))
    assert removed(spark, [(1, one), (2, one.translate(str.maketrans("qz", "zq"))), (3, one)]) == {(3, 0)}


def test_equal_blocks_of_any_place_meet(spark):
    # a dropped word and a letter: the block that both share is an early one of one line and a late one of the other
    assert removed(spark, [(1, "dhk gbmljfbk eli ghbd ikjgdfc aealifke ejahd cfaghjfd"), (2, "dhk eli ghbd ikjgdfc aealifke ejahd cfaghjfdx")]) == {(2, 0)}


def test_similar_by_one_pair_at_a_time():
    rng = np.random.default_rng(7)
    a, b = [], []
    for _ in range(700):
        s = "".join(rng.choice(list("ab é東𐍈"), int(rng.integers(0, 90))))
        a.append(s)
        b.append(s[:9] + "".join(rng.choice(list("ab 東"), int(rng.integers(0, 9)))) + s[12:] if rng.random() < 0.7 else "".join(rng.choice(list("ab é"), int(rng.integers(0, 90)))))
    a += ["x y" * 1500, "q" * 5000, "", "one two three four"]
    b += ["x y" * 1400 + "z", "q" * 4990 + "z", "", "one two six four"]
    most = np.append(rng.integers(0, 40, 700), [301, 10, 0, 4])
    want = [L.distance(s, t, k) <= k for s, t, k in zip(a, b, most.tolist())]
    assert L.similar(a, b, most).tolist() == want and 100 < sum(want) < 600


def test_one_bucket_stands_for_those_of_the_same_lines(spark):
    rows = [(1, 5), (1, 6), (2, 5), (2, 6), (3, 5), (3, 6), (3, 7), (4, 5), (4, 7)]
    got = sorted(map(tuple, L.alike_once(spark.createDataFrame(rows, "bucket long, id long")).collect()))
    assert got == [(1, 5, 2), (1, 6, 2), (3, 5, 1), (3, 6, 1), (3, 7, 1), (4, 5, 1), (4, 7, 1)]


def test_blocks_do_not_depend_on_how_many_words_are_drawn_together(monkeypatch):
    rng = np.random.default_rng(6)
    t = pa.array(["\n".join(" ".join(f"w{int(x)}ord" for x in rng.integers(0, 900, int(rng.integers(5, 60)))) for _ in range(9)) for _ in range(20)])
    _, _, _, size, w0, words, length = L._lines(t)
    want = L._blocks(size, w0, words, length)
    for n in (1, 100):
        monkeypatch.setattr(L, "WORDS", n)
        assert all((x == y).all() for x, y in zip(want, L._blocks(size, w0, words, length)))


def test_blocks_meet_whatever_a_task_holds():
    rng = np.random.default_rng(1)
    for many in (4, 40, 400):
        ids, blocks = rng.integers(-50, 50, 400), rng.integers(0, many, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        want = {}
        for b, i in zip(blocks.tolist(), ids.tolist()):
            want.setdefault(b, set()).add(i)
        batches = [pa.RecordBatch.from_arrays(list(L._dealt(ids[a: a + 37], blocks[a: a + 37], 3)), ["part", "ids", "blocks"]) for a in range(0, 400, 37)]
        assert all(len({k for b in batches for k, x in zip(b["part"].to_pylist(), b["blocks"].to_pylist()) if int(v).to_bytes(8, "little") in {x[j: j + 8] for j in range(0, len(x), 8)}}) == 1 for v in want)
        for held in (30, 100, L.HELD):  # few enough that crowded blocks are passed on in parts, or all at once
            got = {}
            for out in L.meet(iter(batches), held):
                for b, i in zip(out["bucket"].to_pylist(), out["id"].to_pylist()):
                    got.setdefault(b, set()).add(i)
            assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}
    assert not list(L.meet(iter([])))


def test_hashes_do_not_depend_on_how_much_is_hashed_together(monkeypatch):
    text = pa.array(["é one  two\n" * 30 + "z" * 900 + " x " + "y" * 300 + " end"])
    raw, off = B.text_bytes(text)
    starts, ends, _ = B.word_spans(raw, off)
    want = B.span_hashes(B._BYTE[raw], starts, ends)
    for n in (1, 64, 1 << 15):
        monkeypatch.setattr(B, "HASHED", n)
        assert (B.word_hashes(raw, starts, ends) == want).all()
    assert len(B.word_hashes(raw, starts[:0], ends[:0])) == 0


def test_lines_that_are_there_once_and_in_no_bucket_are_not_joined(spark, monkeypatch):
    rows = [(d, "\n".join("".join(map(chr, np.random.default_rng((d, k)).integers(97, 123, 60))) for k in range(20))) for d in range(10)]
    rows += [(20, "twice there\nalone"), (None, "Twice there.\n\ntwice THERE"), (30, None), (31, ""), (31, "a b c d e f\n")]
    kept, keep = {}, B.keep
    monkeypatch.setattr(B, "keep", lambda df, name, *a: kept.setdefault(name, []).append(out := keep(df, name, *a)) or kept.setdefault("rows", []).append((name, out.count())) or out)
    df = keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    gone, counts = L._duplicates(df, L.SIMILARITY, True)
    assert sorted((r.doc_id, r.line) for r in gone.join(df, "key").collect()) == [(None, 0), (None, 2)]
    assert sorted(map(tuple, counts.select("doc_id", "n_lines").collect()), key=str) == sorted(((d, len(t.split("\n")) if t else 0) for d, t in rows), key=str)
    assert max(n for name, n in kept["rows"] if name not in ("lines", "counts")) <= 3


def test_places_by_plain_code():
    rng = np.random.default_rng(2)
    x = np.zeros(300, L.LINE)
    for c, most in (("hash", 90), ("d", 9), ("key", 5), ("line", 4), ("n", 2)):
        x[c] = rng.integers(0, most, 300) + (c == "n") - 40 * (c == "hash")
    ids = rng.choice(np.unique(x["hash"]), 12, replace=False)
    for parts in (1, 7):
        cols = [L._dealt_lines(x[a: a + 50], parts) for a in range(0, 300, 50)]
        got = []
        for p in range(parts):
            packs = [y for part, lines in cols for q, y in zip(part.to_pylist(), lines.to_pylist()) if q == p]
            mine = [i for i in ids.tolist() if i % parts == p]
            batches = [pa.RecordBatch.from_arrays([pa.array(packs, pa.binary()), pa.nulls(len(packs), pa.int64())], ["lines", "id"]), pa.RecordBatch.from_arrays([pa.nulls(len(mine), pa.binary()), pa.array(mine, pa.int64())], ["lines", "id"])]
            got += [tuple(r.values()) for out in L.places(iter(batches)) for r in out.to_pylist()]
        want = []
        for h in set(x["hash"].tolist()):
            mine = sorted((int(r["d"]), int(r["key"]), int(r["line"]), int(r["sim"])) for r in x[x["hash"] == h])
            n = int(x["n"][x["hash"] == h].sum())
            if n > 1 or h in ids:
                want += [(h, *r, n, h in ids, k == 0) for k, r in enumerate(mine)]
        assert sorted(got) == sorted(want) and 0 < len(want) < 300
    assert not list(L.places(iter([])))


def test_pairs_that_are_over_early_do_not_change_the_others(monkeypatch):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 9))))
    x, y = [], []
    for k in range(120):
        s = [word() for _ in range(int(rng.integers(1, 40)))]
        t = [word() for _ in s] if k % 4 else [w if rng.random() < 0.9 else w + "x" for w in s]
        a, b = sorted((" ".join(s), " ".join(t)), key=len)
        x.append(a)
        y.append(b)
    most = np.array([max(len(b) - len(a), len(b) // 5) for a, b in zip(x, y)])
    want = [L.distance(a, b, k) <= k for a, b, k in zip(x, y, most.tolist())]
    for steps in (1, 7, 32, 10_000):
        monkeypatch.setattr(L, "STEPS", steps)
        assert (L._banded(x, y, most) <= most).tolist() == want and 20 < sum(want) < 60


def test_blocks_of_edited_lines_still_meet():
    # shares of real-looking lines that share a block after an edit, at the recall that 64-bit orders had
    rng = np.random.default_rng(12)
    voc = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 11)))) for _ in range(2000)]
    for lo, hi, least in ((9, 16, 0.95), (16, 41, 0.95), (41, 60, 0.95)):
        lines = [[voc[int(i)] for i in rng.integers(0, 2000, int(rng.integers(lo, hi)))] for _ in range(300)]
        other = [[*w[:at], voc[int(rng.integers(0, 2000))], *w[at + 1:]] for w in lines for at in [int(rng.integers(0, len(w)))]]
        _, _, _, size, w0, words, length = L._lines(pa.array(["\n".join(map(" ".join, lines + other))]))
        value, many, _ = L._blocks(size, w0, words, length)
        blocks = [set(x.tolist()) for x in np.split(value, np.cumsum(many)[:-1])]
        assert np.mean([bool(a & b) for a, b in zip(blocks[:300], blocks[300:])]) >= least
