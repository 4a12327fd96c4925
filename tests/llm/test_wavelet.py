import zlib

import numpy as np
import pyarrow as pa
import pytest

from ctxloom.llm import _base as B
from ctxloom.llm import tokens, wavelet

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello  World's\tend.", None, "", "don't 12,5 é ñandú ÀÉ ß", "é x y <|endoftext|>z a<|endoftext|> b", "ΣΑΣ İstanbul ﬁ Ⅷ", "x" * 3000, "a　b\u0085c ﻿d", "🙂🙂 don’t ''s 's"]


def turns(n, a, b):
    """Two sequences of n (a power of two) that every polynomial modulo 2**64 takes for equal from 2,048 on."""
    one = [bin(i).count("1") % 2 for i in range(n)]
    return [b if x else a for x in one], [a if x else b for x in one]


def direct(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_coder_equals_whole_text_encoding():
    ids, n = tokens.coder(PATH)(pa.array(TEXTS), 2)
    want = [direct(t) + [2] for t in TEXTS]
    assert n.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]
    ids, n = tokens.coder(PATH)(pa.array(TEXTS[:4]), None)
    assert ids.tolist() == [i for t in TEXTS[:4] for i in direct(t)]


def test_coder_of_a_tokenizer_that_keeps_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids, n = tokens.coder(path)(pa.array(["a  b", "", None]), 7)
    assert ids.tolist() == [*t.encode("a  b", add_special_tokens=False).ids, 7, 7, 7] and n.sum() == len(ids)


@pytest.mark.parametrize("size,sigma", [(0, 1), (1, 1), (500, 1), (70_000, 300), (200_001, 5)])
def test_wavelet_operations(size, sigma):
    a = np.random.default_rng(size).integers(0, sigma, size).astype(np.uint32) * 7
    w = wavelet.Shard(wavelet.encode(a, np.array([4, 9]), np.array([size, 0]), np.array([False, True])))
    assert w.tokens().tolist() == a.tolist() and w.doc_ids.tolist() == [4, 9] and w.nulls.tolist() == [False, True]
    assert w.count(3) == 0
    for i in range(0, size, max(1, size // 7)):
        assert w.access(i) == a[i]
        assert w.rank(a[i], i) == int((a[:i] == a[i]).sum())
        assert w.select(a[i], w.rank(a[i], i)) == i
        assert w.count(a[i]) == int((a == a[i]).sum())
    if size == 500:
        assert w.occurrences(0) == list(range(500))


def test_documents_round_trip(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "nobody"), (6, "again")]
    df = spark.createDataFrame([(i, t, "src", 1) for i, t in rows], "doc_id long, text string, start string, shard int")
    path = B.new_path(spark, "t")
    shards = wavelet.write_shards(df, path, PATH)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in wavelet.read_documents(spark, path, shards).collect()}
    assert len(got) == len(rows)
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array(direct(t) + [2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((k[0] or -1, *v) for k, v in got.items()) == sorted((i or -1, n, c) for i, n, c in want)
    for r in sorted(got, key=lambda k: k[1]):
        assert r[1] == at
        at += got[r][0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert wavelet.write_shards(df, B.new_path(spark, "t"), PATH).count() == 0


def test_words_that_a_polynomial_cannot_tell_apart():
    assert len({int(x) for x in B.span_hashes(np.array(sum(turns(4096, 3, 5), []), np.uint64), np.array([0, 4096]), np.array([4096, 8192]))}) == 2
    one, two = ("".join(x) for x in turns(2048, "q", "z"))
    for words in ([one, two], [two, one], [one + "7", two + "7", one + "7"]):
        text = " ".join(words)
        got = tokens.coder(PATH)(pa.array([text, *words]), 2)
        assert got[0].tolist() == [i for t in (text, *words) for i in (*direct(t), 2)]


def test_accented_words_are_cut_without_the_pattern(monkeypatch):
    c, asked = tokens.coder(PATH), []
    c.clear()
    monkeypatch.setattr(c, "word", lambda w: asked.append(w) or type(c).word(c, w))
    texts = ["École ÜBER-straße ciónmentellar, 12é3 ÿ", "a×b é÷x E\u0301É don't ¿qué"]
    ids, n = c(pa.array(texts), 2)
    assert ids.tolist() == [i for t in texts for i in (*direct(t), 2)]
    assert sorted(asked) == sorted(["a×b", "é÷x", "E\u0301É", "don't", "¿qué"])


@pytest.mark.parametrize("together", [1, 40, tokens.TOGETHER])
def test_any_mix_of_letters_and_signs(monkeypatch, together):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "TOGETHER", together)
    rng, t = np.random.default_rng(5), Tokenizer.from_file(PATH)
    signs = list("aAéÉßÿŸ×÷ñÀÞþ  \t\n'’12³ªµ«¿<|>ȩ中ǅẞﬁİσΣς.,- ") + ["\u0301", "\u0308", "\u0327", "\u0085", "\u200b", "🙂"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 25)))) for _ in range(1500)] + [None, ""]
    ids, n = tokens.coder(PATH)(pa.array(texts), 2)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert ids.tolist() == [i for x in want for i in (*x, 2)] and n.tolist() == [len(x) + 1 for x in want]
    ids, n = tokens.coder(PATH)(pa.array(texts), None)
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
