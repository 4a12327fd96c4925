"""Best-first search for many queries at once against a heap, one query at a time."""

import heapq
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import frontier, vectors
from ctxloom.plans import q_search
from ctxloom.plans.catalog import QUERIES
from ctxloom.sources.tables import Tables

SF = "/root/testdata/sf0.001"
SCHEMA = "uri string, parent_uri string, level int, embedding array<double>"


def cosine(a, b):
    if a is None or b is None:
        return 0.0
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    s = sum(x * y for x, y in zip(a, b)) / n if n > 0 else 0.0
    return round(s, 6) if math.isfinite(s) else 0.0


def plain(nodes, query, roots, limit, threshold=0.0, alpha=1.0, levels=None, inclusive=False, rescore=None):
    """(results, rounds) by a heap."""
    passes = lambda s: s >= threshold if inclusive else s > threshold
    again = rescore or (lambda uri, s: s)
    scored = [(u, p, lv, cosine(e, query)) for u, p, lv, e in nodes]
    hits = sorted((n for n in scored if n[2] != 2), key=lambda n: (-n[3], n[0]))[: max(limit, 10)]
    hits = [(u, lv, again(u, s)) for u, _, lv, s in hits]
    starts = {}
    for u, _, s in hits:
        starts[u] = max(s, starts.get(u, -9))
    for u in roots:
        starts.setdefault(u, 0.0)
    found = {}
    for u, lv, s in hits:
        if levels is not None and lv in levels and passes(s):
            found[u] = max(s, found.get(u, -9))
    heap, visited, rounds, top, pool, same, idle = [(-s, u) for u, s in starts.items()], set(), 0, [], 0, 0, 0
    heapq.heapify(heap)
    while heap:
        batch = []
        while heap and len(batch) < 4:
            s, u = heapq.heappop(heap)
            if u not in visited:
                visited.add(u)
                batch.append((u, -s))
        if not batch:
            continue
        rounds += 1
        for at, above in batch:
            kids = sorted((n for n in scored if n[1] == at), key=lambda n: (-n[3], n[0]))[: max(2 * limit, 20)]
            for u, _, lv, s in kids:
                s = again(u, s)
                s = round(s * alpha + above * (1 - alpha), 6) if above else s
                if not passes(s):
                    continue
                if levels is None or lv in levels:
                    found[u] = max(s, found.get(u, -9))
                if u not in visited and lv != 2:
                    heapq.heappush(heap, (-s, u))
        now = sorted(sorted(found, key=lambda u: (-found[u], u))[:limit])
        if now == top and len(now) >= limit:
            same += 1
        elif len(found) == pool:
            idle += 1
        else:
            same, idle, top, pool = 0, 0, now, len(found)
        if 3 in (same, idle):
            break
    return [(u, found[u]) for u in sorted(found, key=lambda u: (-found[u], u))[:limit]], rounds


def compare(got, nodes, queries, roots, limit, **more):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, ([], r.rounds))[0].append((r.uri, r.score))
    for q, vector in queries:
        want, rounds = plain(nodes, vector, roots, limit, **more)
        have, ran = by.pop(q, ([], rounds))
        assert [u for u, _ in have] == [u for u, _ in want] and ran == rounds, q
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(have, want))
    assert not by


def tree(seed):
    """Three levels of directories of uneven size; scores on a coarse grid, so ties are many."""
    rng = random.Random(seed)
    vector = lambda: [rng.randint(-4, 6) / 4 for _ in range(3)]
    nodes = [("/r", "", 0, vector())]
    for a in range(5):
        nodes.append((f"/r/{a}", "/r", 0, vector()))
        for b in range(rng.randint(0, 6)):
            nodes.append((f"/r/{a}/{b}", f"/r/{a}", 1, vector()))
            nodes += [(f"/r/{a}/{b}/{c}.md", f"/r/{a}/{b}", 2, rng.choice([vector(), None, [math.nan] * 3, [0.0] * 3])) for c in range(rng.choice([0, 2, 40]))]
    nodes.append(("/other/x.md", "/other", 2, vector()))
    return nodes, [(q, vector()) for q in range(12)]


@pytest.mark.parametrize(("seed", "more"), [(3, {"levels": (0, 1), "threshold": 0.25, "inclusive": True, "alpha": 0.8})])
def test_equals_a_heap(spark, seed, more):
    nodes, queries = tree(seed)
    frame = spark.createDataFrame(nodes, SCHEMA)
    asked = spark.createDataFrame(queries, "query_id long, query array<double>")
    got = frontier.find_thinking(frame, asked, ["/r", "/missing"], 5, **more).collect()
    assert got
    compare(got, nodes, queries, ["/r", "/missing"], 5, **more)


def test_a_reranker_has_the_last_word(spark):
    nodes, queries = tree(5)
    score = lambda uri, s: s if len(uri) % 3 == 0 else round(1.0 - len(uri) / 40, 6)
    odd = F.length("uri") % 3 == 0
    rescore = lambda df: df.withColumn("score", F.when(odd, F.lit(float("nan"))).otherwise(F.round(1.0 - F.length("uri") / 40, 6)))
    got = frontier.find_thinking(spark.createDataFrame(nodes, SCHEMA), spark.createDataFrame(queries, "query_id long, query array<double>"), ["/r"], 5, 0.3, alpha=0.5, rescore=rescore).collect()
    compare(got, nodes, queries, ["/r"], 5, threshold=0.3, alpha=0.5, rescore=score)


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    assert frontier.find_thinking(none, asked, ["/r"], 5).collect() == []
    assert frontier.find_thinking(spark.createDataFrame(tree(1)[0], SCHEMA), asked.limit(0), ["/r"], 5).collect() == []


def test_blocks_of_queries_and_scores_that_are_no_numbers(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [math.nan, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(q, [float(q + 1), 0.0]) for q in range(9)], "query_id long, query array<double>")
    want = [(q, i + 1, v, s) for q in range(9) for i, (v, s) in enumerate([(1, q + 1.0), (2, 0.0), (3, -q - 1.0)])]
    for size in (300, 1 << 20):
        assert sorted(tuple(r) for r in vectors.batch_knn(rows, asked, 3, block_bytes=size).select("query_id", "rank", "vec_id", "score").collect()) == want
    scored = spark.createDataFrame([(1, 0.5), (2, math.nan), (3, -0.5), (4, math.inf)], "vec_id long, score double")
    assert [r.vec_id for r in vectors.top(scored, 3).collect()] == [1, 4, 2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_query_equals_a_heap(spark):
    t = Tables(spark, SF)
    nodes = [tuple(r) for r in q_search.directory_vectors(t).collect()]
    queries = [(r.vec_id, r.embedding) for r in t.embeddings.where("vec_id % 20 = 0").collect()]
    compare(QUERIES["find_thinking"](spark, SF).collect(), nodes, queries, ["/resources"], 10, threshold=0.05, alpha=0.7)


@pytest.mark.parametrize("ahead", [1, 16])
def test_rounds_share_jobs(spark, ahead, monkeypatch):
    """A round was two tables before, so long searches waited for Spark; now a step goes on as far as the children seen allow."""
    monkeypatch.setattr(frontier, "AHEAD", ahead)
    names, real = [], frontier.scratch.written
    monkeypatch.setattr(frontier.scratch, "written", lambda df, name: (names.append(name), real(df, name))[1])
    nodes, queries = tree(7)
    got = frontier.find_thinking(spark.createDataFrame(nodes, SCHEMA), spark.createDataFrame(queries, "query_id long, query array<double>"), ["/r"], 5, 0.1, alpha=0.6).collect()
    compare(got, nodes, queries, ["/r"], 5, threshold=0.1, alpha=0.6)
    rounds = max(r.rounds for r in got)
    assert rounds > 4 and (ahead == 1 or len(names) < 2 * rounds)
