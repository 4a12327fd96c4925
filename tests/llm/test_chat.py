from pyspark.sql import functions as F

from ctxloom.llm import chat

ROWS = [
    (1, 0, "system", "be kind & <brief>"), (1, 1, "user", "a b c </turn>\n<turn:user:new>"), (1, 2, "assistant", "&lt; &amp; x\\"), (1, 3, "user", "d " * 30), (1, 4, "assistant", ""), (1, 5, "assistant", "e f"),
    (2, 0, "assistant", None), (2, None, None, "first"), (2, 0, "assistant", None), (None, 1, "a:b>c<d&", "odd role"), (3, 7, "assistant", "w " * 500), (3, 8, "user", "é🙂"),
]


def plain(rows, budget, turns, tokens):
    """The same windows by a plain loop: conv -> list of (new turns, chars)."""
    out = {}
    for conv in {r[0] for r in rows}:
        t = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        t = [(x[2], x[3], len(x[3].split()) + 4) for x in t]
        head = t[0][2] if t[0][0] == "system" else 0
        windows, used = [[[], []]], 0
        for i, x in enumerate(t):
            if windows[-1][0] and used + x[2] > budget:
                old = []
                for n in range(1, turns + 1):
                    if i - n >= (head > 0) and sum(y[2] for y in t[i - n: i]) <= tokens:
                        old = t[i - n: i]
                if head + sum(y[2] for y in old) + x[2] > budget:
                    old = []
                windows.append([[], ([t[0]] if head else []) + old])
                used = head + sum(y[2] for y in old)
            windows[-1][0].append(x)
            used += x[2]
        out[conv] = windows
    return out


def test_windows_equal_plain_loop_and_round_trip(spark):
    df = spark.createDataFrame([(*r, 9, "x") for r in ROWS], "conv_id long, turn long, role string, text string, window int, pos string")
    for budget, turns, tokens in ((20, 2, 12), (400, 2, 120), (6, 1, 50), (40, 3, 30)):
        want = plain(ROWS, budget, turns, tokens)
        w = chat.format_windows(df, budget, turns, tokens)
        got = {(r.conv_id, r.window): r for r in chat.read_windows(w).collect()}
        assert {k: n for k, n in ((c, len(ws)) for c, ws in want.items())} == {c: sum(k[0] == c for k in got) for c in want}
        for c, ws in want.items():
            for k, (new, old) in enumerate(ws):
                r = got[c, k]
                assert [tuple(x) for x in r.turns] == [x[:2] for x in new]
                assert list(r.targets) == [x[1] for x in new if x[0] == "assistant"]
        for r in w.collect():
            new, old = want[r.conv_id][r.window]
            assert r.formatted.count(":old>") == len(old) and r.n_tokens == sum(x[2] for x in new + old)
            assert r.n_tokens <= budget or len(new) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_windows(chat.format_windows(df)).count() == 0


def test_long_conversations_grow_linearly(spark):
    import time

    def run(n):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 1, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word "), F.lit(90)).alias("text"))
        t0 = time.time()
        w = chat.format_windows(rows).agg(F.count("*").alias("windows"), F.sum("n_tokens").alias("n")).first()
        return time.time() - t0, w

    run(500)
    (a, _), (b, w) = run(4000), run(16000)
    assert w["windows"] > 4000 and b < 8 * a + 2, (a, b)
