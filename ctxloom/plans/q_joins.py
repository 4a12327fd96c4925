"""Joins, set operations and window patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ctxloom.functions import uris
from ctxloom.operators import ranges
from ctxloom.operators import relations as R
from ctxloom.plans.registry import query


def _c(name, sql, f):
    query(name, sql)(f)


@query("join_labels_rows", "SELECT e.vec_id, e.label, d.lang, d.source FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def join_labels_rows(t):
    return t.embeddings.select("vec_id", "label").join(t.documents.select(F.col("doc_id").alias("vec_id"), "lang", "source"), "vec_id")


@query("index_consistency", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def index_consistency(t):
    return t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("graph_edges_valid", "SELECT DISTINCT src, dst, link_type FROM edges WHERE src IN (SELECT doc_id FROM documents) AND dst IN (SELECT doc_id FROM documents)")
def graph_edges_valid(t):
    return R.valid_edges(t.edges, t.documents.select(F.col("doc_id").alias("id"))).select("src", "dst", "link_type")


A = "SELECT uri, lang AS oid FROM ctx WHERE doc_id % 3 <> 0"
B_ = "SELECT uri, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE lang END AS oid FROM ctx WHERE doc_id % 4 <> 0"


@query("snapshot_diff", f", a AS ({A}), b AS ({B_}) SELECT coalesce(a.uri, b.uri) AS uri, CASE WHEN a.uri IS NULL THEN 'write' WHEN b.uri IS NULL THEN 'delete' WHEN a.oid <> b.oid THEN 'write' ELSE 'unchanged' END AS action FROM a FULL JOIN b ON a.uri = b.uri")
def snapshot_diff(t):
    a = t.ctx.where("doc_id % 3 <> 0").select("uri", F.col("lang").alias("oid"))
    b = t.ctx.where("doc_id % 4 <> 0").select("uri", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("lang")).alias("oid"))
    return R.diff(a, b, "uri", "oid")


@query("message_ranges", "SELECT conv_id, turn FROM messages WHERE (turn BETWEEN 0 AND 1) OR (turn BETWEEN 3 AND 4)")
def message_ranges(t):
    r = t.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((0, 0), (1, 1), (3, 4), (4, 4))])).alias("r")).select("r.*")
    merged = R.merged_ranges(r, "lo", "hi")
    turns = merged.select(F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long"))).alias("turn"))
    return t.messages.select("conv_id", "turn").join(turns, "turn")


@query("scope_roots_join", ", r AS (SELECT unnest(['/resources/src1', '/resources/src1/en', '/resources/src2']) AS root) SELECT root, count(*) AS n FROM ctx JOIN r ON uri = root OR starts_with(uri, root || '/') GROUP BY root")
def scope_roots_join(t):
    roots = t.spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("/resources/src1", "/resources/src1/en", "/resources/src2")])).alias("root"))
    return R.under_roots(t.ctx.select("uri"), roots).groupBy("root").agg(F.count("*").alias("n"))


@query("asof_join", """SELECT o_orderkey, event_id FROM (SELECT o_orderkey, event_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY ts DESC, event_id DESC) AS r
  FROM (SELECT o_orderkey, o_custkey % 50 AS k, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * CAST(o_orderkey % 720 AS INT) AS at FROM orders) o JOIN (SELECT user_id % 50 AS k, ts, event_id FROM events) e ON o.k = e.k AND e.ts <= o.at) WHERE r = 1""")
def asof_join(t):
    o = t.orders.select("o_orderkey", (F.col("o_custkey") % 50).alias("k"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=(F.col("o_orderkey") % 720).cast("int"))).alias("at"))
    e = t.events.select((F.col("user_id") % 50).alias("k"), F.col("ts").alias("at"), F.col("event_id"))
    return ranges.as_of(o, e, "k", "at", "event_id").where(F.col("event_id").isNotNull()).select("o_orderkey", "event_id")


EN, HOT = "SELECT doc_id FROM ctx WHERE lang = 'en'", "SELECT doc_id FROM ctx WHERE active_count > 60"


def _en(t):
    return t.ctx.where("lang = 'en'").select("doc_id")


def _hot(t):
    return t.ctx.where("active_count > 60").select("doc_id")


_c("set_intersect", f"{EN} INTERSECT {HOT}", lambda t: _en(t).intersect(_hot(t)))
_c("set_except", f"{EN} EXCEPT {HOT}", lambda t: _en(t).exceptAll(_hot(t)))
_c("set_xor", f"({EN} UNION {HOT}) EXCEPT ({EN} INTERSECT {HOT})", lambda t: R.xor(_en(t), _hot(t), "doc_id"))
_c("set_union", f"{EN} UNION {HOT}", lambda t: _en(t).union(_hot(t)).distinct())

_c("win_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id", lambda t: t.events.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("r = 1").select("user_id", "event_id"))
_c("win_topn_parent", "SELECT parent_uri, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY parent_uri ORDER BY active_count DESC, doc_id) AS r FROM ctx) WHERE r <= 2", lambda t: t.ctx.withColumn("r", F.row_number().over(Window.partitionBy("parent_uri").orderBy(F.desc("active_count"), "doc_id"))).where("r <= 2").select("parent_uri", "doc_id"))
_c("win_keep_last", "SELECT account_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY event_id DESC) AS r FROM usage) WHERE r <= 50", lambda t: t.usage.withColumn("r", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("event_id")))).where("r <= 50").select("account_id", "event_id"))
_c("win_lead_reask", "SELECT conv_id, turn, CASE WHEN n IS NOT NULL AND date_diff('second', ts, n) <= 600 THEN 1 ELSE 0 END AS soon FROM (SELECT *, lead(ts) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM messages)", lambda t: t.messages.withColumn("n", F.lead("ts").over(Window.partitionBy("conv_id").orderBy("turn"))).select("conv_id", "turn", F.when(F.timestamp_diff("SECOND", F.col("ts"), F.col("n")) <= 600, 1).otherwise(0).alias("soon")))
_c("win_cumulative", "SELECT account_id, d, sum(n) OVER (PARTITION BY account_id ORDER BY d)::BIGINT AS total FROM (SELECT account_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, count(*) AS n FROM usage GROUP BY 1, 2)", lambda t: t.usage.groupBy("account_id", F.to_date("ts").cast("string").alias("d")).agg(F.count("*").alias("n")).select("account_id", "d", F.sum("n").over(Window.partitionBy("account_id").orderBy("d")).alias("total")))
_c("win_islands", ", d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM usage), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS grp FROM d) SELECT user_id, CAST(min(day) AS VARCHAR) AS first_day, count(*) AS days FROM g GROUP BY user_id, grp", lambda t: R.islands(t.usage.select("user_id", F.to_date("ts").alias("day")).distinct(), "user_id", "day").select("user_id", F.col("first_day").cast("string").alias("first_day"), "days"))
_c("win_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY account_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS n FROM usage", lambda t: t.usage.select("event_id", F.count("*").over(Window.partitionBy("account_id").orderBy(F.unix_timestamp(F.col("ts").cast("timestamp"))).rangeBetween(-600, 0)).alias("n")))
_c("win_ranks", "SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY active_count DESC) AS r, dense_rank() OVER (PARTITION BY lang ORDER BY active_count DESC) AS dr FROM ctx", lambda t: t.ctx.select("doc_id", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("active_count"))).cast("long").alias("r"), F.dense_rank().over(Window.partitionBy("lang").orderBy(F.desc("active_count"))).cast("long").alias("dr")))
_c("star_join", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name", lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")))


# ---------------------------------------------------------------- merge operators and the link graph

UPD = ", u AS (SELECT user_id, event_id AS seq, event_type, value FROM events)"
_c("merge_sum", UPD + " SELECT user_id, round(sum(value), 4) AS total FROM u GROUP BY user_id", lambda t: R.merge(t.events.withColumnRenamed("event_id", "seq"), "user_id", "seq", {"value": "sum"}).select("user_id", F.round("value", 4).alias("total")))
_c("merge_immutable", UPD + " SELECT user_id, arg_min(event_type, seq) AS event_type FROM u GROUP BY user_id", lambda t: R.merge(t.events.withColumnRenamed("event_id", "seq"), "user_id", "seq", {"event_type": "immutable"}))
_c("merge_replace", UPD + " SELECT user_id, arg_max(event_type, seq) FILTER (event_type <> 'error') AS event_type FROM u GROUP BY user_id", lambda t: R.merge(t.events.withColumnRenamed("event_id", "seq").withColumn("event_type", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("")), "user_id", "seq", {"event_type": "replace"}))
_c("merge_by_schema", UPD + " SELECT user_id, round(sum(value), 4) AS value, arg_min(seq, seq) AS first_seq, arg_max(event_type, seq) AS event_type FROM u GROUP BY user_id", lambda t: R.merge(t.events.withColumnRenamed("event_id", "seq").withColumn("first_seq", F.col("seq")), "user_id", "seq", {"value": "sum", "first_seq": "immutable", "event_type": "replace"}).withColumn("value", F.round("value", 4)))
_c("merge_links", ", e AS (SELECT src % 50 AS a, dst % 50 AS b, link_type, weight, seq FROM edges) SELECT a, b, max(weight) AS weight, arg_max(link_type, seq) AS link_type, min(seq) AS created FROM e GROUP BY a, b", lambda t: R.merge_links(t.edges.select((F.col("src") % 50).alias("a"), (F.col("dst") % 50).alias("b"), "link_type", "weight", "seq"), ["a", "b"], "seq").select("a", "b", "weight", "link_type", "created"))
_c("link_normalize", "SELECT src, CASE WHEN regexp_matches(link_type || CASE WHEN src % 7 = 0 THEN ' Bad!' ELSE '' END, '^[a-z]+(_[a-z]+){0,2}$') THEN link_type ELSE 'related_to' END AS link_type, CASE WHEN src % 9 = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, weight * 2)) END AS weight FROM edges", lambda t: R.normalised_links(t.edges.select("src", F.concat("link_type", F.when(F.col("src") % 7 == 0, " Bad!").otherwise("")).alias("link_type"), F.when(F.col("src") % 9 == 0, "bad").otherwise((F.col("weight") * 2).cast("string")).alias("weight"))))
_c("graph_backlinks", "SELECT dst AS id, count(*) AS n, min(src) AS first FROM edges GROUP BY dst", lambda t: R.backlinks(t.edges).select("id", F.size("sources").cast("long").alias("n"), F.array_min("sources").alias("first")))
_c("graph_build", "SELECT d.doc_id AS id, substr(text, 1, 600) AS preview, (SELECT count(*) FROM (SELECT DISTINCT src, dst, link_type FROM edges WHERE dst IN (SELECT doc_id FROM documents)) x WHERE x.src = d.doc_id) AS links FROM documents d", lambda t: R.graph(t.documents.select(F.col("doc_id").alias("id"), "text"), t.edges))
_c("memory_diff", ", a AS (SELECT doc_id, lang AS v FROM ctx WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE lang END AS v FROM ctx WHERE doc_id % 4 <> 0) SELECT CASE WHEN a.doc_id IS NULL THEN 'add' WHEN b.doc_id IS NULL THEN 'delete' WHEN a.v <> b.v THEN 'update' ELSE 'same' END AS kind, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1", lambda t: R.change_kinds(t.ctx.where("doc_id % 3 <> 0").select("doc_id", F.col("lang").alias("v")), t.ctx.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("lang")).alias("v")), "doc_id", "v").groupBy("kind").agg(F.count("*").alias("n")))
_c("relations", "SELECT src, count(*) AS n FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY src", lambda t: R.both_ways(t.edges.select("src", "dst")).groupBy("src").agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- directory passes, tasks

@query("dag_levels", ", d AS (SELECT DISTINCT parent_uri AS uri FROM ctx UNION SELECT DISTINCT '/resources/' || source FROM ctx UNION SELECT '/resources') SELECT uri, len(list_filter(string_split(uri, '/'), lambda x: x <> '')) AS depth, (SELECT count(*) FROM ctx WHERE starts_with(ctx.uri, d.uri || '/')) AS files FROM d")
def dag_levels(t):
    d = t.ctx.select(F.explode(uris.ancestors(F.col("uri"))).alias("uri")).groupBy("uri").agg(F.count("*").alias("files"))
    return d.select("uri", uris.depth(F.col("uri")).cast("long").alias("depth"), "files")


@query("dag_changed", ", c AS (SELECT uri, doc_id % 200 = 0 AS changed FROM ctx), d AS (SELECT DISTINCT parent_uri AS uri FROM ctx UNION SELECT DISTINCT '/resources/' || source FROM ctx UNION SELECT '/resources') SELECT d.uri, bool_or(changed) AS changed FROM d JOIN c ON starts_with(c.uri, d.uri || '/') GROUP BY d.uri")
def dag_changed(t):
    return t.ctx.select(F.explode(uris.ancestors(F.col("uri"))).alias("uri"), (F.col("doc_id") % 200 == 0).alias("changed")).groupBy("uri").agg(F.bool_or("changed").alias("changed"))


_c("tracker_complete", "SELECT operation, user_id FROM usage GROUP BY operation, user_id HAVING count(*) = count(*) FILTER (status_code < 400)", lambda t: t.usage.groupBy("operation", "user_id").agg((F.count("*") - F.count_if(F.col("status_code") < 400)).alias("left")).where("left = 0").select("operation", "user_id"))
_c("task_evict", "SELECT event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS r FROM usage WHERE NOT (status_code < 400 AND ts < TIMESTAMP '2024-01-30 00:00:00') AND NOT (status_code >= 400 AND ts < TIMESTAMP '2024-01-24 00:00:00')) WHERE r <= 500", lambda t: t.usage.where(~((F.col("status_code") < 400) & (F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz"))) & ~((F.col("status_code") >= 400) & (F.col("ts") < F.lit("2024-01-24").cast("timestamp_ntz")))).orderBy(F.desc("event_id")).limit(500).select("event_id"))
_c("watch_due", "SELECT user_id, last + INTERVAL 6 HOUR AS next_run FROM (SELECT user_id, max(ts) AS last FROM usage GROUP BY user_id) WHERE last + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-31 00:00:00'", lambda t: t.usage.groupBy("user_id").agg((F.max("ts") + F.make_interval(hours=F.lit(6))).alias("next_run")).where(F.col("next_run") <= F.lit("2024-01-31").cast("timestamp_ntz")))
