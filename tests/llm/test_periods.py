"""Periodic runs against a plain search over all stretches, and the query against the same on a small table."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ctxloom.llm import periods

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """All stretches with period p by comparing words p apart, then the smallest period of each stretch."""
    n, best = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - s
            if length >= max(24, 3 * p):
                best.setdefault((s, length), p)  # periods rise
    return sorted((s, n_, p) for (s, n_), p in best.items())


def plain_row(doc_id, text, change=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if change and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = set()
    for s, length, p in runs:
        dropped.update(range(s + p, s + length))
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n_},{p}\n" for s, n_, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def cases():
    rng = random.Random(5)
    out = [[], ["a"] * 23, ["a"] * 24, ["a"] * 100, list("ab") * 50, list("abc") * 8, list("abc") * 7 + list("ab"), ["a"] * 30 + ["b"] * 30 + ["a"] * 30]
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 6)):
            block = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
            words += block * rng.randint(1, 9) + block[: rng.randint(0, len(block))]
        out.append(words)
    out += [[rng.choice("ab") for _ in range(300)] for _ in range(30)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    return [*out, list(fib[-1])]


def test_runs_of_many_documents_at_once():
    docs = cases()
    ids = {w: i for i, w in enumerate(sorted({w for ws in docs for w in ws}))}
    doc, start, length, period = periods.find_runs(np.array([ids[w] for ws in docs for w in ws]), np.array([len(w) for w in docs]))
    got = [[] for _ in docs]
    for row in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[row[0]].append(row[1:])
    assert got == [plain_runs(w) for w in docs]


def test_extensions_are_common_prefixes():
    rng = np.random.default_rng(3)
    for n, letters in ((1, 1), (2, 1), (50, 1), (200, 2), (300, 5)):
        s = rng.integers(0, letters, n)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]

        def plain(a, b, s=s, n=n):
            k = 0
            while max(a, b) + k < n and s[a + k] == s[b + k]:
                k += 1
            return k

        if len(i):
            assert periods.Extensions(s).lce(i, j).tolist() == [plain(a, b) for a, b in zip(i, j)]


def test_steps_do_not_change_the_result(monkeypatch):
    docs = cases()
    words, sizes = np.array([ord(w[0]) for ws in docs for w in ws]), np.array([len(w) for w in docs])
    whole = [x.tolist() for x in periods.find_runs(words, sizes)]
    monkeypatch.setattr(periods, "STEP", 7)
    assert [x.tolist() for x in periods.find_runs(words, sizes)] == whole


def test_odd_rows(spark):
    long = " ".join(["p q r"] * 30_000)
    other = "".join("1" if bin(i).count("1") % 2 else "2" for i in range(1024))  # equal under any polynomial hash modulo 2**64 with its complement
    clash = " ".join([other, other.translate(str.maketrans("12", "21"))] + ["x"] * 23)
    rows = [(1, None, 5), (2, "", 5), (None, "a " * 40, 5), (None, None, 5), (3, "a b " * 30, 5), (3, "a b " * 30, 5), (4, long, 5), (5, clash, 5), (2**40, "A a " * 40, 5), (13, "one two three", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period int")
    got = sorted((tuple(r) for r in periods.collapse(docs, periods.repeat_tail).select(*COLUMNS).collect()), key=repr)
    assert [r for r in got if r[0] != 4] == sorted((plain_row(i, t) for i, t, _ in rows if t != long), key=repr)
    four = next(r for r in got if r[0] == 4)
    assert four[1] == 1 and four[4] == 3
    assert periods.collapse(docs.limit(0)).collect() == []


def test_texts_come_back(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 20 + "y")], "doc_id long, text string")
    row = periods.collapse(docs).first()
    assert (row.runs, row.collapsed, row.n_dropped) == ("1,40,2\n", "x a b y", 38)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_equals_the_plain_version(spark):
    got = sorted(tuple(r) for r in periods.op13(spark, SF).select(*COLUMNS).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == sorted(plain_row(r.doc_id, r.text) for r in docs)
    assert any(r[1] for r in got)
