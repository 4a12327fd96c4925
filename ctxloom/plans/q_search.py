"""Retrieval queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ctxloom.functions import uris
from ctxloom.operators import dsl, frontier
from ctxloom.operators import retrieve as R
from ctxloom.operators import vectors as V
from ctxloom.plans.registry import query

NOW = "2024-02-01 00:00:00"
S_SQL = ", s AS (SELECT *, round((doc_id * 7919 % 1000) / 1000.0::DOUBLE, 6) AS score FROM ctx)"
HOT = f"CASE WHEN updated_at IS NULL THEN 0 ELSE (1.0 + active_count)::DOUBLE / (2.0 + active_count) * exp(-ln(2) / 7.0 * greatest(0, date_diff('second', updated_at, TIMESTAMP '{NOW}') / 86400.0)) END"


def _scored(t):
    return t.ctx.withColumn("score", F.round((F.col("doc_id") * 7919 % 1000) / 1000.0, 6))


def _hot():
    return R.hotness(F.col("active_count"), F.col("updated_at"), F.lit(NOW).cast("timestamp_ntz"))


@query("find_quick", S_SQL + ", p AS (SELECT * FROM s ORDER BY score DESC, doc_id DESC LIMIT 20) SELECT uri, score FROM p WHERE score > 0.99 ORDER BY score DESC, doc_id DESC LIMIT 20")
def find_quick(t):
    return R.find_quick(_scored(t).select("uri", "doc_id", "score"), 20, 0.99).select("uri", "score")


def _tree(t):
    d = _scored(t).select("uri", "parent_uri", F.lit(False).alias("is_dir"), "score")
    dirs = t.ctx.select(F.explode(uris.ancestors(F.col("uri"))).alias("uri")).distinct()
    dirs = dirs.select("uri", F.when(F.length(uris.parent(F.col("uri"))) > 0, uris.parent(F.col("uri"))).alias("parent_uri"), F.lit(True).alias("is_dir"), (F.pmod(F.hash("uri"), F.lit(100)) / 100.0 + 0.3).alias("score"))
    return dirs.unionByName(d)


@query("find_hier")
def find_hier(t):
    return R.find_hierarchical(_tree(t), 10, 0.4)


def directory_vectors(t):
    """(uri, parent_uri, level, embedding) of all files, with the embedding of their id, and of all directories, with the mean of what is below."""
    files = t.ctx.select("doc_id", "uri", "parent_uri").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), V.doubles(F.col("embedding")).alias("embedding")), "doc_id", "left")
    parts = files.where("embedding IS NOT NULL").select(F.explode(uris.ancestors(F.col("uri"))).alias("uri"), "embedding").select("uri", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("uri", "i").agg(F.avg("x").alias("x")).groupBy("uri").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
    dirs = means.select("uri", uris.parent(F.col("uri")).alias("parent_uri"), F.when(uris.depth(F.col("uri")) <= 2, 0).otherwise(1).alias("level"), "embedding")
    return dirs.unionByName(files.select("uri", "parent_uri", F.lit(2).alias("level"), "embedding"))


@query("find_thinking")
def find_thinking(t):
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), V.doubles(F.col("embedding")).alias("query"))
    return frontier.find_thinking(directory_vectors(t), queries, ["/resources"], 10, 0.05, alpha=0.7)


@query("children_topn", S_SQL + " SELECT parent_uri, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY parent_uri ORDER BY score DESC, doc_id DESC) AS rank FROM s) WHERE rank <= 3")
def children_topn(t):
    return R.children_top(_scored(t), 3).select("parent_uri", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("score_propagate", S_SQL + ", p AS (SELECT parent_uri, max(score) FILTER (level = 0) AS ps FROM s GROUP BY parent_uri) SELECT doc_id, round(CASE WHEN coalesce(ps, 0) <> 0 THEN score * 0.6::DOUBLE + coalesce(ps, 0) * 0.4::DOUBLE ELSE score END, 6) AS score FROM s JOIN p USING (parent_uri)")
def score_propagate(t):
    s = _scored(t)
    p = s.groupBy("parent_uri").agg(F.max(F.when(F.col("level") == 0, F.col("score"))).alias("ps"))
    return s.join(p, "parent_uri").select("doc_id", F.round(R.propagated(F.col("score"), F.coalesce("ps", F.lit(0.0)), 0.6), 6).alias("score"))


@query("dedupe_max", S_SQL + " SELECT parent_uri, score, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_uri ORDER BY score DESC, doc_id DESC) AS r FROM s) WHERE r = 1")
def dedupe_max(t):
    return R.best_per(_scored(t).select("parent_uri", "score", "doc_id"), "parent_uri", tie="doc_id")


@query("hotness_score", f"SELECT doc_id, round({HOT}, 6) AS hot FROM ctx")
def hotness_score(t):
    return t.ctx.select("doc_id", F.round(_hot(), 6).alias("hot"))


@query("hotness_blend", S_SQL + f" SELECT doc_id, round(score * 0.8::DOUBLE + 0.2::DOUBLE * {HOT}, 6) AS final FROM s ORDER BY final DESC, doc_id LIMIT 25")
def hotness_blend(t):
    return _scored(t).select("doc_id", F.round(R.blended(F.col("score"), _hot(), 0.2), 6).alias("final")).orderBy(F.desc("final"), "doc_id").limit(25)


@query("level_suffix", "SELECT doc_id, uri || CASE level WHEN 0 THEN '/.abstract.md' WHEN 1 THEN '/.overview.md' ELSE '' END AS uri FROM ctx")
def level_suffix(t):
    return t.ctx.select("doc_id", uris.with_level_suffix(F.col("uri"), F.col("level")).alias("uri"))


@query("tenant_scope", "SELECT doc_id FROM ctx WHERE account_id = 'acct_1' AND (starts_with(uri, '/resources/src1/') OR starts_with(uri, '/resources/src2/'))")
def tenant_scope(t):
    return R.visible(t.ctx, "acct_1", ["/resources/src1", "/resources/src2"]).select("doc_id")


@query("acl_filter", "SELECT doc_id, CASE WHEN account_id = 'acct_0' THEN 'own' WHEN starts_with(uri, '/resources/src0/') THEN 'shared' ELSE 'denied' END AS access FROM ctx")
def acl_filter(t):
    return t.ctx.select("doc_id", F.when(F.col("account_id") == "acct_0", "own").when(uris.under(F.col("uri"), "/resources/src0"), "shared").otherwise("denied").alias("access"))


@query("search_shortcuts", "SELECT doc_id FROM ctx WHERE level IN (0, 1) AND context_type = 'memory' AND list_contains(search_tags, 'lang=en') AND updated_at >= TIMESTAMP '2024-01-11 00:00:00' AND updated_at <= TIMESTAMP '2024-01-25 23:59:59.999999'")
def search_shortcuts(t):
    node = R.shortcuts(dt.datetime(2024, 2, 1), level=[0, 1], context_type="memory", tags=[" LANG=en"], since="21d", until="2024-01-25")
    return dsl.where(t.ctx, node).select("doc_id")


@query("multi_query_union", ", w AS (SELECT unnest(['the', 'die', 'les']) AS term) SELECT context_type, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM ctx, w WHERE contains(content, term) GROUP BY context_type")
def multi_query_union(t):
    out = None
    for term in ("the", "die", "les"):
        part = dsl.where(t.ctx, {"op": "contains", "field": "content", "substring": term}).select("context_type", "doc_id")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("context_type").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query("find_result_split", S_SQL + " SELECT context_type, count(*) AS n, round(max(score), 6) AS best FROM (SELECT * FROM s ORDER BY score DESC, doc_id DESC LIMIT 100) GROUP BY context_type")
def find_result_split(t):
    return _scored(t).orderBy(F.desc("score"), F.desc("doc_id")).limit(100).groupBy("context_type").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@query("skills_union", S_SQL + " SELECT doc_id, score, scope FROM (SELECT doc_id, score, 'user' AS scope FROM s WHERE context_type = 'skill' AND account_id = 'acct_0' UNION ALL SELECT doc_id, score, 'shared' FROM s WHERE context_type = 'skill' AND lang = 'en') ORDER BY score DESC, doc_id, scope LIMIT 30")
def skills_union(t):
    s = _scored(t).where("context_type = 'skill'").select("doc_id", "score", "account_id", "lang")
    a = s.where("account_id = 'acct_0'").select("doc_id", "score", F.lit("user").alias("scope"))
    return a.unionByName(s.where("lang = 'en'").select("doc_id", "score", F.lit("shared").alias("scope"))).orderBy(F.desc("score"), "doc_id", "scope").limit(30)


@query("score_distribution", S_SQL + " SELECT count(*) AS n, round(min(score), 6) AS low, round(max(score), 6) AS high, round(avg(score), 6) AS mean, count(*) FILTER (score > 0.5) AS above FROM s")
def score_distribution(t):
    return R.distribution(_scored(t), 0.5)


@query("trace_stats", "SELECT operation, count(*) AS n, round(min(duration_ms), 6) AS low, round(max(duration_ms), 6) AS high, round(avg(duration_ms), 6) AS mean FROM usage GROUP BY operation")
def trace_stats(t):
    d = F.col("duration_ms")
    return t.usage.groupBy("operation").agg(F.count("*").alias("n"), F.round(F.min(d), 6).alias("low"), F.round(F.max(d), 6).alias("high"), F.round(F.avg(d), 6).alias("mean"))


@query("active_increment", ", h AS (SELECT event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, count(*) AS n FROM usage WHERE operation = 'find' GROUP BY 1) SELECT doc_id, active_count + coalesce(n, 0) AS active_count FROM ctx LEFT JOIN h USING (doc_id)")
def active_increment(t):
    last = t.documents.agg((F.max("doc_id") + 1).alias("all"))  # one row
    hits = t.usage.where("operation = 'find'").crossJoin(F.broadcast(last)).groupBy((F.col("event_id") % F.col("all")).alias("doc_id")).agg(F.count("*").alias("n"))
    return t.ctx.join(hits, "doc_id", "left").select("doc_id", (F.col("active_count") + F.coalesce("n", F.lit(0))).alias("active_count"))


@query("tags_append", "SELECT doc_id, array_to_string(list_concat(search_tags, CASE WHEN doc_id % 2 = 0 THEN ['even=yes'] ELSE [] END), ';') AS tags FROM ctx")
def tags_append(t):
    more = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("even=yes"))).otherwise(F.array(F.concat(F.lit("src="), "source")))
    return t.ctx.select("doc_id", F.array_join(F.array_union("search_tags", more), ";").alias("tags"))


@query("uri_rewrite", "SELECT doc_id, n AS uri, md5(concat(account_id, ':', n, CASE level WHEN 0 THEN '/.abstract.md' WHEN 1 THEN '/.overview.md' ELSE '' END)) AS id FROM (SELECT *, '/moved/s0' || substr(uri, 16) AS n FROM ctx WHERE starts_with(uri, '/resources/src0/'))")
def uri_rewrite(t):
    c = t.ctx.where(uris.under(F.col("uri"), "/resources/src0")).withColumn("uri", uris.rewritten(F.col("uri"), "/resources/src0", "/moved/s0"))
    return c.select("doc_id", "uri", uris.record_id(F.col("account_id"), F.col("uri"), F.col("level")).alias("id"))


@query("vector_copy", "SELECT vec_id, '/copy' || uri AS uri, 0 AS active_count, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM ctx JOIN embeddings ON vec_id = doc_id WHERE starts_with(uri, '/resources/src3/')")
def vector_copy(t):
    c = t.ctx.where(uris.under(F.col("uri"), "/resources/src3")).select(F.col("doc_id").alias("vec_id"), uris.rewritten(F.col("uri"), "/", "/copy").alias("uri"))
    return c.join(t.embeddings, "vec_id").select("vec_id", F.concat(F.lit("/copy"), F.regexp_replace("uri", "^/copy/?", "/")).alias("uri"), F.lit(0).alias("active_count"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("find_threshold_gte", S_SQL + " SELECT uri, score FROM (SELECT * FROM s ORDER BY score DESC, doc_id DESC LIMIT 10) WHERE score >= 0.99 ORDER BY score DESC, doc_id DESC LIMIT 5")
def find_threshold_gte(t):
    return R.find_quick(_scored(t).select("uri", "doc_id", "score"), 5, 0.99, inclusive=True).select("uri", "score")
