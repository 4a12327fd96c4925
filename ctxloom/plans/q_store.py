"""Scans, point reads, mutations, paging, change replay, queues and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.functions import uris
from ctxloom.operators import store as S
from ctxloom.plans.registry import query

NOW = "2024-01-15 00:00:00"


def ts(x):
    return F.lit(x).cast("timestamp_ntz")


@query("scan_all", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_all(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("fetch_by_keys", "SELECT k AS o_orderkey, o_totalprice, o_totalprice IS NOT NULL AS found FROM (SELECT unnest([1, 7, 5, 99999999, 32]) AS k) LEFT JOIN orders ON k = o_orderkey")
def fetch_by_keys(t):
    keys = t.spark.range(1).select(F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 7, 5, 99999999, 32)])).alias("o_orderkey"))
    return S.fetch(t.orders.select("o_orderkey", "o_totalprice"), keys, "o_orderkey")


@query("delta_since", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def delta_since(t):
    return t.events.select("event_id", "ts").where(F.col("ts") >= ts("2024-01-20 00:00:00"))


@query("delta_before", "SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-03 00:00:00'")
def delta_before(t):
    return t.events.select("event_id", "ts").where(F.col("ts") < ts("2024-01-03 00:00:00"))


@query("upsert_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(t):
    return S.latest(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("upsert_rows", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'NEW' ELSE p_brand END AS p_brand FROM part")
def upsert_rows(t):
    p = t.part.select("p_partkey", "p_brand")
    return S.upsert(p, p.where("p_partkey % 10 = 0").withColumn("p_brand", F.lit("NEW")), "p_partkey")


@query("update_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def update_merge(t):
    c = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    return S.merge(c, c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")), "c_custkey", ["c_acctbal"])


@query("update_unmatched", "SELECT c_custkey + 1000000 AS c_custkey FROM customer WHERE c_custkey % 100 = 0")
def update_unmatched(t):
    new = t.customer.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey")).unionByName(t.customer.where("c_custkey = 1").select("c_custkey"))
    return S.unmatched(t.customer, new, "c_custkey")


@query("partial_upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS s_name, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def partial_upsert(t):
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    new = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), F.when(F.col("s_suppkey") % 4 == 0, F.lit(0.0)).alias("s_acctbal"))
    return S.merge(s, new, "s_suppkey", ["s_name", "s_acctbal"])


@query("delete_keys", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def delete_keys(t):
    return S.delete_keys(t.orders.select("o_orderkey"), t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("delete_where", "SELECT doc_id FROM ctx WHERE NOT (lang = 'en' AND active_count > 50)")
def delete_where(t):
    return S.delete_where(t.ctx, (F.col("lang") == "en") & (F.col("active_count") > 50)).select("doc_id")


@query("delete_subtree", "SELECT doc_id FROM ctx WHERE NOT (uri = '/resources/src0' OR starts_with(uri, '/resources/src0/'))")
def delete_subtree(t):
    return S.delete_subtree(t.ctx, "/resources/src0").select("doc_id")


@query("ttl_expire", f"SELECT doc_id FROM ctx WHERE doc_id % 5 = 0 OR updated_at + INTERVAL 48 HOUR > TIMESTAMP '{NOW}'")
def ttl_expire(t):
    c = t.ctx.withColumn("expire_at", F.when(F.col("doc_id") % 5 != 0, F.col("updated_at") + F.make_interval(hours=F.lit(48))))
    return S.alive(c, ts(NOW)).select("doc_id")


@query("scroll_page", "SELECT doc_id, uri FROM ctx WHERE doc_id > 99 ORDER BY doc_id LIMIT 40")
def scroll_page(t):
    return S.page(t.ctx.select("doc_id", "uri"), "doc_id", 99, 40)


@query("delta_replay", """, last AS (SELECT user_id % 200 AS k, event_id, event_type, row_number() OVER (PARTITION BY user_id % 200 ORDER BY event_id DESC) AS r FROM events),
base AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer)
SELECT k, v FROM base WHERE k NOT IN (SELECT k FROM last WHERE r = 1) UNION ALL SELECT k, event_type FROM last WHERE r = 1 AND event_type <> 'error'""")
def delta_replay(t):
    base = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    changes = t.events.select((F.col("user_id") % 200).alias("k"), F.col("event_type").alias("v"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT").alias("kind"), F.col("event_id").alias("seq"))
    return S.replay(base, changes, "k")


QUEUE = f""", q AS (SELECT operation AS queue_name, event_id AS message_id, CASE event_id % 4 WHEN 0 THEN 'processing' WHEN 1 THEN 'done' ELSE 'pending' END AS status, ts AS since FROM usage)"""


def _queue(t):
    status = F.when(F.col("event_id") % 4 == 0, "processing").when(F.col("event_id") % 4 == 1, "done").otherwise("pending")
    return t.usage.select(F.col("operation").alias("queue_name"), F.col("event_id").alias("message_id"), status.alias("status"), F.col("ts").alias("since"))


@query("queue_peek", QUEUE + " SELECT queue_name, min(message_id) AS message_id FROM q WHERE status = 'pending' GROUP BY queue_name")
def queue_peek(t):
    return S.head(_queue(t)).select("queue_name", "message_id")


@query("queue_size", QUEUE + " SELECT queue_name, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing FROM q GROUP BY queue_name")
def queue_size(t):
    return _queue(t).groupBy("queue_name").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "processing").alias("processing"))


@query("queue_recover_stale", QUEUE + f" SELECT message_id, CASE WHEN status = 'processing' AND since < TIMESTAMP '{NOW}' - INTERVAL 600 SECOND THEN 'pending' ELSE status END AS status FROM q")
def queue_recover_stale(t):
    return S.recover_stale(_queue(t), ts(NOW), 600).select("message_id", "status")


@query("queue_ack", QUEUE + " SELECT queue_name, count(*) AS n FROM q WHERE status <> 'done' GROUP BY queue_name")
def queue_ack(t):
    q = _queue(t)
    return S.delete_keys(q, q.where("status = 'done'"), "message_id").groupBy("queue_name").agg(F.count("*").alias("n"))


@query("pack_manifest", "SELECT uri AS path, length(content) AS size, sha256(content) AS sha256 FROM ctx")
def pack_manifest(t):
    return S.pack_manifest(t.ctx)


@query("pack_import_skip", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'new' END AS lang FROM ctx WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def pack_import_skip(t):
    c = t.ctx.select("doc_id", "lang")
    return S.import_pack(c.where("doc_id % 2 = 0"), c.where("doc_id % 3 = 0").withColumn("lang", F.lit("new")), "doc_id", "skip")


@query("pack_import_overwrite", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang FROM ctx WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def pack_import_overwrite(t):
    c = t.ctx.select("doc_id", "lang")
    return S.import_pack(c.where("doc_id % 2 = 0"), c.where("doc_id % 3 = 0").withColumn("lang", F.lit("new")), "doc_id", "overwrite")


@query("fs_rename_children", "SELECT doc_id, CASE WHEN starts_with(uri, '/resources/src1/') THEN '/archive/one' || substr(uri, 16) ELSE uri END AS uri FROM ctx")
def fs_rename_children(t):
    return t.ctx.select("doc_id", uris.rewritten(F.col("uri"), "/resources/src1", "/archive/one").alias("uri"))


@query("dir_scan_classify", """SELECT url, CASE WHEN regexp_matches(url, '/\\.[^/]*$') THEN 'hidden' WHEN length(html) = 0 THEN 'empty' WHEN regexp_matches(url, '[02468]$') THEN 'processable' ELSE 'unsupported' END AS kind FROM pages""")
def dir_scan_classify(t):
    u = F.col("url")
    return t.pages.select("url", F.when(u.rlike(r"/\.[^/]*$"), "hidden").when(F.length("html") == 0, "empty").when(u.rlike("[02468]$"), "processable").otherwise("unsupported").alias("kind"))


@query("gitignore_filter", """SELECT doc_id, uri FROM ctx WHERE NOT (regexp_matches(uri, '^/resources/src1/') AND NOT regexp_matches(uri, '/de/[^/]*$'))""")
def gitignore_filter(t):
    from ctxloom.sources.files import ignored

    rules = ["# comment", "/resources/src1/**", "!/resources/src1/de/*"]
    return t.ctx.where(~ignored(F.col("uri"), rules)).select("doc_id", "uri")


@query("feed_filter", """, p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, url FROM pages WHERE regexp_matches(url, '^https?://'))
SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS r FROM p WHERE host = (SELECT min(host) FROM p)) WHERE r = 1""")
def feed_filter(t):
    from ctxloom.sources.files import feed_entries

    return feed_entries(t.pages.select("page_id", "url"))


@query("project_known", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 <> 0 THEN 'level' END, CASE WHEN doc_id % 7 <> 0 THEN 'lang' END, 'source') AS fields, CASE WHEN doc_id % 7 <> 0 THEN lang END AS lang FROM ctx")
def project_known(t):
    """Records with the fields of a schema; some values are missing, one field isn't in the table and several columns are in no schema."""
    c = t.ctx.withColumn("level", F.when(F.col("doc_id") % 5 != 0, F.col("level"))).withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    r = S.known_fields(c, "doc_id", ["level", "lang", "source", "nothing"])
    return r.select("doc_id", F.array_join(F.json_object_keys("record"), ",").alias("fields"), F.get_json_object("record", "$.lang").alias("lang"))
