"""Best-first search of a directory tree for many queries at once.

For each query: the best directories by vector (over the whole tree) and the roots are where the search starts. A round opens the
best directories that are not open yet, four a query; their best children are scored, mixed with the directory's
score, and those that pass become results or directories to open. A query ends when its results have not changed, or none has
come, for three rounds, or nothing is left to open.

All queries advance together, several rounds a step. A step compares the best directories that each query may open next with their
children, by directory, whatever the number of queries (see nearest); then each query goes on by itself until it comes to a directory whose
children it hasn't seen. So a step is a job, and most searches take a few; some children are scored that are never asked for. What a query
has met is written each step, and of its children only the best few of each task are shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ctxloom.operators import nearest
from ctxloom.sources import scratch

#: Directories that a query opens in a round; rounds without a change that end it; directories that start it, at least.
FAN_OUT, PATIENCE, SEEDS = 4, 3, 10
FILE_LEVEL = 2
#: Directories of a query whose children are scored in a step; as many as it has opened, if these are more.
AHEAD = 16
#: What is known of a query: met (a row a node), kid (children seen, not opened yet), got (their directories), state (one row), ask (directories to look into next) and result.
KNOWN = "kind string, uri string, parent_uri string, level int, open_score double, score double, opened boolean, top array<string>, pool long, same int, idle int, rounds int"

Rescore = Callable[[DataFrame], DataFrame]


def _best(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows of each key by score, then uri."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "uri"))).where(F.col("_r") <= n).drop("_r")


def _reranked(df: DataFrame, rescore: Rescore | None) -> DataFrame:
    """Scores of the reranker where they are finite."""
    if rescore is None:
        return df
    usable = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    return rescore(df.withColumn("_vector", F.col("score"))).withColumn("score", F.when(usable, F.col("score")).otherwise(F.col("_vector"))).drop("_vector")


def passes(score, threshold: float, inclusive: bool):
    return score >= threshold if inclusive else score > threshold


def find_thinking(
    nodes: DataFrame, queries: DataFrame, roots: list[str], limit: int, threshold: float = 0.0, inclusive: bool = False, alpha: float = 1.0, kind: str = "cosine", levels: tuple[int, ...] | None = None, rescore: Rescore | None = None
) -> DataFrame:
    """(query_id, rank, uri, score, rounds): the best `limit` results of each query.

    nodes: uri, parent_uri, level (0 and 1 are directories, 2 files), embedding. queries: query_id, query (a vector). alpha: weight of
    a node's own score against its directory's. levels: levels of results (all; directories that start the search are results only if they are asked for). rescore: a
    reranker, (query_id, uri, level, score, ...) -> the same with other scores. Ties of scores go by uri. Queries without results have no rows.
    """
    vec = scratch.written(queries.select("query_id", "query"), "queries")
    tree = scratch.written(nodes.select("uri", "parent_uri", "level", "embedding"), "tree")
    sizes = scratch.written(nearest.sizes(tree, "embedding", "parent_uri"), "sizes")
    wanted = F.lit(True) if levels is None else F.col("level").isin(*levels)
    dirs = tree.where(F.col("level") != FILE_LEVEL)

    # where the search starts: a stated query set against all directories
    hits = nearest.nearest(dirs.select("uri", "level", "embedding"), vec, max(limit, SEEDS), kind, "uri", largest=False)
    hits = scratch.written(_reranked(_best(hits, ["query_id"], max(limit, SEEDS)), rescore), "seeds")
    always = vec.select("query_id", F.explode(F.array(*map(F.lit, roots))).alias("uri"), F.lit(0.0).alias("score"))
    # a root that is a hit keeps the hit's score, even one below 0
    starts = hits.select("query_id", "uri", "score").unionByName(always).groupBy("query_id", "uri").agg(F.max_by("score", F.struct(F.col("score") != 0, "score")).alias("open_score"))
    asked_for = wanted & passes(F.col("score"), threshold, inclusive) if levels is not None else F.lit(False)
    first = hits.where(asked_for).select("query_id", "uri", "score")
    own = lambda df, kind: df.withColumn("kind", F.lit(kind))
    begun = own(starts, "met").unionByName(own(first, "met"), True)
    begun = begun.unionByName(own(vec.select("query_id", F.array().cast("array<string>").alias("top"), F.lit(0).cast("long").alias("pool"), F.lit(0).alias("same"), F.lit(0).alias("idle"), F.lit(0).alias("rounds")), "state"), True)
    schema = StructType([vec.schema["query_id"], *StructType.fromDDL(KNOWN)])
    blank = queries.sparkSession.createDataFrame([], schema)
    go = _until_unseen(schema.names, limit, threshold, inclusive, alpha, levels)
    advanced = lambda df: scratch.written(blank.unionByName(df, True).groupBy("query_id").applyInArrow(go, schema), "search")
    search = advanced(begun)
    steps = [search]
    scratch.drop(hits)
    while not (asks := search.where("kind = 'ask'").select("query_id", "uri")).isEmpty():
        asked = asks.withColumnRenamed("uri", "parent_uri").join(vec, "query_id")
        kids = nearest.nearest(tree, asked, max(2 * limit, 20), kind, "uri", largest=False, within="parent_uri", row_sizes=sizes)
        kids = _reranked(_best(kids, ["query_id", "parent_uri"], max(2 * limit, 20)), rescore)
        kept = search.where("kind NOT IN ('ask', 'result')")
        search = advanced(kept.unionByName(own(asks, "got"), True).unionByName(own(kids.select("query_id", "parent_uri", "uri", "level", "score"), "kid"), True))
        steps.append(search)
    found = steps[0]
    for more in steps[1:]:
        found = found.unionByName(more)
    out = scratch.written(found.where("kind = 'result'").select("query_id", F.col("pool").cast("int").alias("rank"), "uri", "score", "rounds"), "found")
    scratch.drop(*steps, tree, sizes, vec)
    return out


def _until_unseen(names: list[str], limit: int, threshold: float, inclusive: bool, alpha: float, levels: tuple[int, ...] | None) -> Callable[[pa.Table], pa.Table]:
    """A query's rows (KNOWN) after as many rounds as its children seen allow."""

    def go(table: pa.Table) -> pa.Table:
        met: dict[str, list] = {}  # uri: best scores as a directory to open and as a result, and whether it is open
        kids: dict[str, list] = {}
        top, pool, same, idle, rounds = [], 0, 0, 0, 0

        def meet(uri: str, open_score: float | None, score: float | None, opened: bool = False) -> None:
            m = met.setdefault(uri, [None, None, False])
            m[0] = open_score if m[0] is None or open_score is not None and open_score > m[0] else m[0]
            m[1] = score if m[1] is None or score is not None and score > m[1] else m[1]
            m[2] |= opened

        for row in zip(*(table.column(c).to_pylist() for c in names[1:])):
            kind, uri, parent, level, open_score, score, opened, *counters = row
            if kind == "met":
                meet(uri, open_score, score, bool(opened))
            elif kind == "got":
                kids.setdefault(uri, [])
            elif kind == "kid":
                kids.setdefault(parent, []).append((uri, level, score))
            else:
                top, pool, same, idle, rounds = counters
        is_dir = lambda level: level is not None and level != FILE_LEVEL

        def expected(live: list[tuple[float, str]]) -> list[tuple[float, str]]:
            """Directories unseen that may be opened soon: those that can be now, and those below the ones seen but not opened yet."""
            soon, todo = {}, [(u, -s) for s, u in live]
            while todo:
                u, above = todo.pop()
                if u not in soon:
                    soon[u] = above
                    todo += [(k, score) for k, level, s in kids.get(u, ()) if is_dir(level) and k not in met and passes(score := s * alpha + above * (1 - alpha), threshold, inclusive)]
            return [(-s, u) for u, s in soon.items() if u not in kids]

        best = lambda n, of: [(u, -s) for s, u in heapq.nsmallest(n, of)]
        asks: list[str] = []
        while same < PATIENCE and idle < PATIENCE:
            live = [(-m[0], u) for u, m in met.items() if m[0] is not None and not m[2]]
            opening = best(FAN_OUT, live)
            if any(u not in kids for u, _ in opening):
                asks = [u for u, _ in opening if u not in kids]
                asks += [u for u, _ in best(max(AHEAD, FAN_OUT * rounds), expected(live)) if u not in asks]
                break
            if not opening:
                break
            for u, _ in opening:
                met[u][2] = True
            for u, above in opening:
                some = kids.pop(u)
                # a directory's score of exactly 0 leaves the score alone
                raw = np.array([s for _, _, s in some], np.float64)
                mixed = nearest.rounded(raw * alpha + above * (1 - alpha) if above != 0 else raw).tolist()
                for (uri, level, _), score in zip(some, mixed):
                    if passes(score, threshold, inclusive):
                        meet(uri, score if is_dir(level) else None, score if levels is None or level in levels else None)
            results = [(-m[1], u) for u, m in met.items() if m[1] is not None]
            now = sorted(u for u, _ in best(limit, results))
            rounds += 1
            if now == top and len(now) >= limit:
                same += 1
            elif len(results) == pool:
                idle += 1
            else:
                top, pool, same, idle = now, len(results), 0, 0
        out = []
        if asks:
            out.append(("state", None, None, None, None, None, None, top, pool, same, idle, rounds))
            rest = (None,) * 5
            out += [("met", u, None, None, *m, *rest) for u, m in met.items()]
            out += [("got", u, None, None, None, None, None, *rest) for u in kids]
            out += [("kid", u, p, level, None, s, None, *rest) for p, some in kids.items() for u, level, s in some]
            out += [("ask", u, None, None, None, None, None, *rest) for u in asks]
        else:
            results = best(limit, ((-m[1], u) for u, m in met.items() if m[1] is not None))
            out += [("result", u, None, None, None, s, None, None, i + 1, None, None, rounds) for i, (u, s) in enumerate(results)]
        kinds = table.schema
        ids = pa.array(table.column(names[0]).to_pylist()[:1] * len(out), kinds.field(names[0]).type)
        return pa.table([ids, *(pa.array([r[i] for r in out], kinds.field(c).type) for i, c in enumerate(names[1:]))], names=names)

    return go
