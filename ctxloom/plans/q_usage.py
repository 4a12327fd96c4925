"""Aggregations and operational analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ctxloom.operators import dsl
from ctxloom.operators import ranges
from ctxloom.operators import usage as U
from ctxloom.plans.registry import query

EN = {"op": "must", "field": "lang", "conds": ["en"]}


def _c(name, sql, f):
    query(name, sql)(f)


_c("agg_count", "SELECT count(*) AS n FROM ctx", lambda t: dsl.count_rows(t.ctx))
_c("agg_count_filtered", "SELECT count(*) AS n FROM ctx WHERE lang = 'en'", lambda t: dsl.count_rows(t.ctx, node=EN))
_c("agg_count_by", "SELECT lang AS key, count(*) AS n FROM ctx GROUP BY lang", lambda t: dsl.count_rows(t.ctx, "lang"))
_c("agg_count_by_list", "SELECT key, count(*) AS n FROM (SELECT unnest(search_tags) AS key FROM ctx) GROUP BY key", lambda t: dsl.count_rows(t.ctx, "search_tags"))
_c("agg_count_zero", "SELECT source AS key, count(*) FILTER (lang = 'en' AND active_count > 95) AS n FROM ctx GROUP BY source", lambda t: dsl.count_rows(t.ctx, "source", {"op": "and", "conds": [EN, {"op": "range", "field": "active_count", "gt": 95}]}, keep_zero=True))
_c("agg_count_by2", "SELECT lang || ',' || level AS key, count(*) AS n FROM ctx GROUP BY lang, level", lambda t: dsl.count_rows(t.ctx, ["lang", "level"]))
_c("agg_having", "SELECT source AS key, count(*) AS n FROM ctx GROUP BY source HAVING count(*) > 40 ORDER BY key LIMIT 5", lambda t: dsl.count_rows(t.ctx, "source", having={"gt": 40}, max_entry=5))
_c("agg_having_all", "SELECT source AS key, count(*) AS n FROM ctx GROUP BY source HAVING count(*) >= 40 AND count(*) < 200", lambda t: dsl.count_rows(t.ctx, "source", having={"gte": 40, "lt": 200}))
_c("agg_distinct", "SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM ctx", lambda t: t.ctx.agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources")))
_c("agg_cube", "SELECT lang, level, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT lang, 'L' || level AS level, n_chars FROM ctx) GROUP BY CUBE (lang, level)", lambda t: t.ctx.withColumn("level", F.concat(F.lit("L"), "level")).cube("lang", "level").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")))
_c("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", lambda t: t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")))


@query("usage_token_hourly", "SELECT account_id, user_id, date_trunc('hour', ts) AS hour, operation, sum(tokens)::BIGINT AS tokens FROM usage GROUP BY ALL")
def usage_token_hourly(t):
    return U.hourly(t.usage, ["account_id", "user_id", "operation"], [F.sum("tokens").alias("tokens")])


@query("usage_retrieval_hourly", "SELECT operation, status_code, date_trunc('hour', ts) AS hour, count(*) AS n FROM usage WHERE operation IN ('find', 'search') GROUP BY ALL")
def usage_retrieval_hourly(t):
    return U.hourly(t.usage.where("operation in ('find', 'search')"), ["operation", "status_code"], [F.count("*").alias("n")])


@query("usage_context_hourly", "SELECT account_id, operation, date_trunc('hour', ts) AS hour, count(*) AS n FROM usage WHERE operation IN ('add_resource', 'session.commit') AND status_code BETWEEN 200 AND 399 GROUP BY ALL")
def usage_context_hourly(t):
    return U.hourly(t.usage.where(F.col("operation").isin("add_resource", "session.commit") & U.success(F.col("status_code"))), ["account_id", "operation"], [F.count("*").alias("n")])


@query("usage_incremental", "SELECT account_id, operation, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM usage GROUP BY ALL")
def usage_incremental(t):
    g = lambda d: d.groupBy("account_id", "operation").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    old, new = g(t.usage.where("event_id % 3 <> 0")), g(t.usage.where("event_id % 3 = 0"))
    return old.unionByName(new).groupBy("account_id", "operation").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))


LOCAL = "ts + INTERVAL 8 HOUR"


@query("usage_today_tokens", f"SELECT account_id, sum(tokens) FILTER (operation = 'find')::BIGINT AS find_tokens, sum(tokens)::BIGINT AS tokens FROM usage WHERE CAST({LOCAL} AS DATE) = DATE '2024-01-15' GROUP BY account_id")
def usage_today_tokens(t):
    u = t.usage.where(F.to_date(U.in_zone(F.col("ts"), 8)) == F.lit("2024-01-15").cast("date"))
    return u.groupBy("account_id").agg(F.sum(F.when(F.col("operation") == "find", F.col("tokens"))).alias("find_tokens"), F.sum("tokens").alias("tokens"))


@query("usage_today_retrievals", f"SELECT operation, count(*) AS n FROM usage WHERE operation IN ('find', 'search') AND CAST({LOCAL} AS DATE) = DATE '2024-01-15' GROUP BY operation")
def usage_today_retrievals(t):
    return t.usage.where(F.col("operation").isin("find", "search") & (F.to_date(U.in_zone(F.col("ts"), 8)) == F.lit("2024-01-15").cast("date"))).groupBy("operation").agg(F.count("*").alias("n"))


@query("usage_token_series", f""", d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-10', INTERVAL 1 DAY)) AS DATE) AS day),
a AS (SELECT CAST({LOCAL} AS DATE) AS day, sum(tokens)::BIGINT AS tokens, count(*) AS calls, count(*) FILTER (operation = 'find') AS finds FROM usage GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, coalesce(tokens, 0) AS tokens, coalesce(calls, 0) AS calls, coalesce(finds, 0) AS finds FROM d LEFT JOIN a USING (day)""")
def usage_token_series(t):
    a = t.usage.groupBy(F.to_date(U.in_zone(F.col("ts"), 8)).alias("day")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"), F.count_if(F.col("operation") == "find").alias("finds"))
    return U.dense_days(a, "2023-12-30", "2024-01-10", fill=["tokens", "calls", "finds"]).withColumn("day", F.col("day").cast("string"))


def _heat(t, hours):
    grid = t.spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-07").cast("date"))).alias("day")).select("day", F.explode(F.sequence(F.lit(0), F.lit(23), F.lit(hours))).alias("slot"))
    local = U.in_zone(F.col("ts"), 8)
    n = t.usage.groupBy(F.to_date(local).alias("day"), (F.floor(F.hour(local) / hours) * hours).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    return grid.join(n, ["day", "slot"], "left").select(F.col("day").cast("string").alias("day"), "slot", F.coalesce("n", F.lit(0)).alias("n"))


for h in (1, 4):
    _c(f"usage_heatmap_{h}h", f""", g AS (SELECT CAST(d AS DATE) AS day, CAST(s AS INT) AS slot FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-07', INTERVAL 1 DAY)) AS d), (SELECT unnest(generate_series(0, 23, {h})) AS s)),
n AS (SELECT CAST({LOCAL} AS DATE) AS day, CAST(hour({LOCAL}) // {h} * {h} AS INT) AS slot, count(*) AS n FROM usage GROUP BY 1, 2) SELECT CAST(day AS VARCHAR) AS day, slot, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (day, slot)""", lambda t, h=h: _heat(t, h))


@query("audit_page", "SELECT event_id, account_id, operation, status_code FROM usage WHERE account_id = 'acct_1' AND status_code >= 400 ORDER BY event_id DESC LIMIT 20 OFFSET 20")
def audit_page(t):
    return t.usage.where("account_id = 'acct_1' and status_code >= 400").orderBy(F.desc("event_id")).offset(20).limit(20).select("event_id", "account_id", "operation", "status_code")


@query("audit_success_rate", "SELECT account_id, count(*) AS total, round(count(*) FILTER (status_code BETWEEN 200 AND 399) / count(*), 6) AS success_rate FROM usage GROUP BY account_id")
def audit_success_rate(t):
    ok = F.count_if(U.success(F.col("status_code")))
    return t.usage.groupBy("account_id").agg(F.count("*").alias("total"), U.ratio(ok, F.count("*")).alias("success_rate"))


@query("audit_status_class", "SELECT status_code // 100 || 'xx' AS class, count(*) AS n FROM usage GROUP BY 1")
def audit_status_class(t):
    return t.usage.groupBy(U.status_class(F.col("status_code")).alias("class")).agg(F.count("*").alias("n"))


@query("retention_days", "SELECT event_id FROM (SELECT *, max(CAST(ts AS DATE)) OVER (PARTITION BY account_id) AS last FROM usage) WHERE CAST(ts AS DATE) > last - 7")
def retention_days(t):
    return U.keep_days(t.usage, "account_id", 7).select("event_id")


@query("retention_rows", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY event_id DESC) AS r FROM usage) WHERE r <= 100")
def retention_rows(t):
    return U.keep_rows(t.usage, "account_id", 100, "event_id").select("event_id")


@query("inventory_counts", "SELECT count(*) FILTER (context_type = 'resource') AS files, count(*) FILTER (context_type = 'skill') AS skills, count(*) FILTER (context_type = 'memory') AS memories, count(*) AS total FROM ctx")
def inventory_counts(t):
    n = lambda k: F.count_if(F.col("context_type") == k)
    return t.ctx.agg(n("resource").alias("files"), n("skill").alias("skills"), n("memory").alias("memories"), F.count("*").alias("total"))


NOW = "2024-02-01 00:00:00"
HOT = f"((1.0 + active_count)::DOUBLE / (2.0 + active_count) * exp(-ln(2) / 7.0 * greatest(0, date_diff('second', updated_at, TIMESTAMP '{NOW}') / 86400.0)))"


def _hot():
    from ctxloom.operators.retrieve import hotness

    return hotness(F.col("active_count"), F.col("updated_at"), F.lit(NOW).cast("timestamp_ntz"))


def _age():
    return F.timestamp_diff("SECOND", F.col("updated_at"), F.lit(NOW).cast("timestamp_ntz")) / 86400.0


@query("memory_stats", f"SELECT context_type, count(*) AS n, round(max(date_diff('second', updated_at, TIMESTAMP '{NOW}') / 86400.0), 6) AS oldest_days, sum(active_count)::BIGINT AS uses FROM ctx GROUP BY context_type")
def memory_stats(t):
    return t.ctx.groupBy("context_type").agg(F.count("*").alias("n"), F.round(F.max(_age()), 6).alias("oldest_days"), F.sum("active_count").alias("uses"))


@query("hotness_buckets", f"SELECT CASE WHEN h < 0.2 THEN 'cold' WHEN h > 0.6 THEN 'hot' ELSE 'warm' END AS bucket, count(*) AS n FROM (SELECT {HOT} AS h FROM ctx) GROUP BY 1")
def hotness_buckets(t):
    h = F.col("h")
    return t.ctx.select(_hot().alias("h")).groupBy(F.when(h < 0.2, "cold").when(h > 0.6, "hot").otherwise("warm").alias("bucket")).agg(F.count("*").alias("n"))


@query("staleness", f"SELECT context_type, count(*) FILTER (a > 7) AS over_7d, count(*) FILTER (a > 30) AS over_30d FROM (SELECT context_type, date_diff('second', updated_at, TIMESTAMP '{NOW}') / 86400.0 AS a FROM ctx) GROUP BY 1")
def staleness(t):
    return t.ctx.groupBy("context_type").agg(F.count_if(_age() > 7).alias("over_7d"), F.count_if(_age() > 30).alias("over_30d"))


@query("retrieval_stats", "SELECT operation, count(*) AS n, round(count(*) FILTER (tokens = 0) / count(*), 6) AS zero_rate, round(avg(duration_ms), 6) AS mean_ms, min(tokens) AS low, max(tokens) AS high FROM usage WHERE operation IN ('find', 'search') GROUP BY operation")
def retrieval_stats(t):
    return t.usage.where("operation in ('find', 'search')").groupBy("operation").agg(F.count("*").alias("n"), U.ratio(F.count_if(F.col("tokens") == 0), F.count("*")).alias("zero_rate"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.min("tokens").alias("low"), F.max("tokens").alias("high"))


OUT = """, o AS (SELECT m.*, (SELECT min(n.ts) FROM messages n WHERE n.conv_id = m.conv_id AND n.turn > m.turn AND n.role = 'user') AS next_ts, (SELECT count(*) FROM messages n WHERE n.conv_id = m.conv_id AND n.turn > m.turn AND n.role = 'user') AS follow_ups FROM messages m WHERE role = 'assistant'),
oc AS (SELECT *, CASE WHEN next_ts IS NULL THEN 'resolved' WHEN date_diff('second', ts, next_ts) <= 600 THEN 'reasked' ELSE 'followed_up' END AS outcome FROM o)"""


@query("outcome_label", OUT + " SELECT response_id, outcome, follow_ups FROM oc")
def outcome_label(t):
    return U.outcomes(t.messages).select("response_id", "outcome", "follow_ups")


RATES = "count(*) AS responses, round(count(*) FILTER (outcome = 'reasked') / count(*), 6) AS reask_rate, round(count(*) FILTER (outcome = 'resolved') / count(*), 6) AS resolved_rate, count(DISTINCT conv_id) AS sessions"


def _rates():
    r = lambda k: U.ratio(F.count_if(F.col("outcome") == k), F.count("*"))
    return [F.count("*").alias("responses"), r("reasked").alias("reask_rate"), r("resolved").alias("resolved_rate"), F.count_distinct("conv_id").alias("sessions")]


_c("feedback_channel", OUT + f" SELECT channel, {RATES} FROM oc GROUP BY channel", lambda t: U.outcomes(t.messages).groupBy("channel").agg(*_rates()))
_c("feedback_summary", OUT + f" SELECT {RATES} FROM oc", lambda t: U.outcomes(t.messages).agg(*_rates()))
_c("feedback_topn", OUT + " SELECT conv_id, count(*) FILTER (outcome = 'reasked') AS reasks FROM oc GROUP BY conv_id ORDER BY reasks DESC, conv_id LIMIT 10", lambda t: U.outcomes(t.messages).groupBy("conv_id").agg(F.count_if(F.col("outcome") == "reasked").alias("reasks")).orderBy(F.desc("reasks"), "conv_id").limit(10))
_c("feedback_rollup", OUT + " SELECT channel, outcome, count(*) AS n FROM oc GROUP BY ROLLUP (channel, outcome)", lambda t: U.outcomes(t.messages).rollup("channel", "outcome").agg(F.count("*").alias("n")))

LAT = "count(*) AS n, round(avg(CASE WHEN status_code BETWEEN 200 AND 399 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(duration_ms), 6) AS mean, round(max(duration_ms), 6) AS worst, count(*) FILTER (duration_ms > 100) AS slow, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.9), 6) AS p90, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99"
_c("latency_summary", f"SELECT operation, {LAT} FROM usage GROUP BY operation", lambda t: U.latency(t.usage, ["operation"]))
_c("latency_all", f"SELECT {LAT} FROM usage", lambda t: U.latency(t.usage, []))
_c("latency_windows", f"SELECT w, {LAT} FROM (SELECT *, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS w FROM usage) GROUP BY w", lambda t: U.latency(t.usage.withColumn("w", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400)), ["w"]))
_c("pctl", "SELECT round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.75), 6) AS p75 FROM orders", lambda t: ranges.percentiles(t.orders, [], "o_totalprice", [0.25, 0.75]).select(F.round(F.get("p", 0), 6).alias("p25"), F.round(F.get("p", 1), 6).alias("p75")))
_c("task_summary", "SELECT operation, count(*) AS total, count(*) FILTER (status_code < 400) AS done, count(*) FILTER (status_code >= 400) AS failed FROM usage GROUP BY operation", lambda t: t.usage.groupBy("operation").agg(F.count("*").alias("total"), F.count_if(F.col("status_code") < 400).alias("done"), F.count_if(F.col("status_code") >= 400).alias("failed")))
_c("error_top", "SELECT operation, status_code, count(*) AS n FROM usage WHERE status_code >= 400 GROUP BY ALL ORDER BY n DESC, operation, status_code LIMIT 5", lambda t: t.usage.where("status_code >= 400").groupBy("operation", "status_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "operation", "status_code").limit(5))
_c("oplog_stats", "SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type", lambda t: t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
_c("oplog_nested", "SELECT c AS call, count(*) AS n FROM (SELECT unnest(list_value(operation, CASE WHEN tokens > 50 THEN 'embed' ELSE 'read' END)) AS c FROM usage) GROUP BY c", lambda t: t.usage.select(F.explode(F.array("operation", F.when(F.col("tokens") > 50, "embed").otherwise("read"))).alias("call")).groupBy("call").agg(F.count("*").alias("n")))
_c("histogram_buckets", ", b AS (SELECT unnest([0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]::DOUBLE[]) AS le) SELECT CAST(le AS VARCHAR) AS le, (SELECT count(*) FROM usage WHERE duration_ms / 1000.0 <= le) AS n FROM b UNION ALL SELECT '+Inf', count(duration_ms) FROM usage", lambda t: U.histogram(t.usage, F.col("duration_ms") / 1000.0))
_c("tenant_overflow", ", f AS (SELECT user_id, min(event_id) AS f FROM usage GROUP BY user_id ORDER BY f, user_id LIMIT 20) SELECT CASE WHEN f IS NULL THEN '__overflow__' ELSE u.user_id END AS tenant, count(*) AS n FROM usage u LEFT JOIN f USING (user_id) GROUP BY 1", lambda t: U.limited_tenants(t.usage, "user_id", "event_id", 20).groupBy("tenant").agg(F.count("*").alias("n")))
_c("cache_hit_rate", "SELECT operation, round(count(*) FILTER (status_code = 302) / count(*), 6) AS hit_rate FROM usage GROUP BY operation", lambda t: t.usage.groupBy("operation").agg(U.ratio(F.count_if(F.col("status_code") == 302), F.count("*")).alias("hit_rate")))


@query("set_prf", """, p AS (SELECT doc_id FROM ctx WHERE lang = 'en'), q AS (SELECT doc_id FROM ctx WHERE active_count > 50),
x AS (SELECT count(*) FILTER (p.doc_id IS NOT NULL AND q.doc_id IS NOT NULL) AS tp, count(*) FILTER (q.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn FROM p FULL JOIN q ON p.doc_id = q.doc_id)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision_, round(tp / (tp + fn), 6) AS recall_, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM x""")
def set_prf(t):
    p, q = t.ctx.where("lang = 'en'").select("doc_id", F.lit(1).alias("p")), t.ctx.where("active_count > 50").select("doc_id", F.lit(1).alias("q"))
    x = p.join(q, "doc_id", "full_outer").agg(F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull()).alias("tp"), F.count_if(F.col("q").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    one = lambda a, b: F.when((tp + fp + fn) == 0, 1.0).otherwise(U.ratio(a, b))
    return x.select("tp", "fp", "fn", one(tp, tp + fp).alias("precision_"), one(tp, tp + fn).alias("recall_"), one(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("judge_accuracy", "SELECT category, count(*) AS n, count(*) FILTER (status_code = 200) AS correct, round(count(*) FILTER (status_code = 200) / count(*), 6) AS accuracy, round(avg(duration_ms), 6) AS mean_ms, round(avg(tokens), 6) AS mean_tokens FROM (SELECT *, 'c' || event_id % 6 AS category FROM usage) WHERE category <> 'c5' GROUP BY ROLLUP (category)")
def judge_accuracy(t):
    u = t.usage.withColumn("category", F.concat(F.lit("c"), F.col("event_id") % 6)).where("category <> 'c5'")
    ok = F.count_if(F.col("status_code") == 200)
    return u.rollup("category").agg(F.count("*").alias("n"), ok.alias("correct"), U.ratio(ok, F.count("*")).alias("accuracy"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.round(F.avg("tokens"), 6).alias("mean_tokens"))


_c("token_usage_rollup", "SELECT account_id, operation, sum(tokens)::BIGINT AS tokens, count(*) AS calls FROM usage GROUP BY ROLLUP (account_id, operation)", lambda t: t.usage.rollup("account_id", "operation").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls")))


@query("counter_delta", ", c AS (SELECT account_id, date_trunc('day', ts) AS d, sum(tokens)::BIGINT AS v FROM usage GROUP BY 1, 2), s AS (SELECT account_id, d, sum(v) OVER (PARTITION BY account_id ORDER BY d)::BIGINT AS total FROM c) SELECT account_id, d, greatest(0, total - coalesce(lag(total) OVER (PARTITION BY account_id ORDER BY d), 0)) AS delta FROM s")
def counter_delta(t):
    c = t.usage.groupBy("account_id", F.date_trunc("day", "ts").alias("d")).agg(F.sum("tokens").alias("v"))
    s = c.withColumn("total", F.sum("v").over(Window.partitionBy("account_id").orderBy("d")))
    return U.deltas(s, "account_id", "d", "total").select("account_id", "d", "delta")


_c("locks_hanging", "SELECT event_id FROM usage WHERE operation = 'session.commit' AND date_diff('second', ts, TIMESTAMP '2024-01-31 00:00:00') > 600", lambda t: t.usage.where("operation = 'session.commit'").where(F.col("ts") < F.lit("2024-01-31").cast("timestamp_ntz") - F.make_interval(secs=F.lit(600))).select("event_id"))  # turns of the second count, as in date_diff
