import numpy as np

from ctxloom.llm import substrings as S


def turns(n, a, b):
    """Two sequences of n (a power of two) that every polynomial modulo 2**64 takes for equal from 2,048 on."""
    one = [bin(i).count("1") % 2 for i in range(n)]
    return [b if x else a for x in one], [a if x else b for x in one]


def brute(rows, window):
    """(n_words, n_removed, kept) of each row by a dictionary of all windows."""
    first = {}
    key = lambda d: S.LAST if d is None else d
    for d, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            g = tuple(w[k: k + window])
            first[g] = min(first.get(g, S.LAST), key(d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k: k + window])] < key(d):
                gone[k: k + window] = [True] * window
        out.append((d, len(w), sum(gone), b" ".join(a for a, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def got(spark, rows, window):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, piece int, d string").repartition(3)
    return sorted((tuple(r) for r in S.remove_repeats(df, window).select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)


def test_slide_min():
    a = np.random.default_rng(0).integers(0, 99, 200)
    for w in (1, 2, 3, 5, 8, 31):
        assert S._slide_min(a, w).tolist() == [a[i: i + w].min() for i in range(201 - w)]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    word = lambda: f"w{int(rng.integers(0, 400))}"
    shared = [[word() for _ in range(int(rng.integers(5, 90)))] for _ in range(6)]
    for window in (7, 50):
        rows = []
        for d in range(60):
            w = [word() for _ in range(int(rng.integers(0, 60)))]
            for _ in range(int(rng.integers(0, 4))):
                s = shared[int(rng.integers(0, 6))]
                a = int(rng.integers(0, max(1, len(s) // 2)))
                at = int(rng.integers(0, len(w) + 1))
                w[at:at] = s[a: int(rng.integers(a, len(s) + 1))]
            rows.append((int(rng.integers(0, 1000)), ("\t " if d % 2 else " ").join(w)))
        rows += [(2000 + k, rows[k][1].replace("w7", "W7")) for k in range(20)] + [(3000 + k, rows[k][1]) for k in range(10)]
        assert got(spark, rows, window) == brute(rows, window)


def test_repetitive_texts_ties_and_odd_rows(spark):
    rows = [(1, "a " * 300), (2, "a " * 20), (3, "b " + "a " * 9 + "b"), (4, "a b " * 100), (5, " b a" * 30), (6, None), (7, ""), (None, "a " * 40), (None, "z y x w v u t s"), (8, "z y x w v u t s r"), (8, "q z y x w v u t s"), (8, "q z y x w v u t s")]
    assert got(spark, rows, 6) == brute(rows, 6)


def test_empty(spark):
    assert got(spark, [], 5) == []


def test_words_and_passages_that_a_polynomial_cannot_tell_apart(spark):
    one, two = ("".join(x) for x in turns(2048, "q", "z"))
    passage = [f"p{i}" for i in range(45)]
    rows = [(1, " ".join([*passage, one, *passage])), (2, " ".join([*passage, two, *passage]))]
    rows += [(k + 3, " ".join(x)) for k, x in enumerate(turns(4096, "left", "right"))]
    assert got(spark, rows, 50) == brute(rows, 50)
    assert brute(rows[:2], 50)[1][2] == 0
