"""Tables of a data folder and the context views derived from them.

Views: ctx (context records), usage (usage events) and messages (session messages). Each has the same
SQL for DuckDB in VIEWS_SQL, so a query and its oracle start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0 = "2024-01-01 00:00:00"


class Tables:
    """Lazy access by attribute: Tables(spark, dir).orders, .ctx, .usage, .messages, .edges."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def ctx(self) -> DataFrame:
        d = self.documents
        s = lambda c: F.col(c).cast("string")
        uri = F.concat(F.lit("/resources/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), s("doc_id"), F.lit(".md"))
        account = F.concat(F.lit("acct_"), (F.col("doc_id") % 3).cast("string"))
        start = F.lit(T0).cast("timestamp_ntz")
        hours = lambda n: F.make_interval(hours=n.cast("int"))
        return d.select(
            F.md5(F.concat(account, F.lit(":"), uri)).alias("id"), uri.alias("uri"), F.concat(F.lit("/resources/"), F.col("source"), F.lit("/"), F.col("lang")).alias("parent_uri"), account.alias("account_id"),
            F.when(F.col("doc_id") % 4 == 0, "memory").when(F.col("doc_id") % 4 == 1, "skill").otherwise("resource").alias("context_type"),
            (F.col("doc_id") % 3).cast("int").alias("level"), ((F.col("doc_id") * 37) % 101).alias("active_count"),
            (start + hours(F.col("doc_id") % 720)).alias("created_at"), (start + hours(F.col("doc_id") % 720 + 24)).alias("updated_at"),
            F.array(F.concat(F.lit("lang="), F.col("lang")), F.concat(F.lit("src="), F.col("source"))).alias("search_tags"),
            ((F.col("doc_id") * 7) % 359 - 179).cast("double").alias("lon"), ((F.col("doc_id") * 3) % 179 - 89).cast("double").alias("lat"),
            "lang", "source", "n_chars", F.col("text").alias("content"), "doc_id")

    @property
    def usage(self) -> DataFrame:
        e = self.events
        op = F.when(F.col("event_type") == "view", "find").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "purchase", "add_resource").when(F.col("event_type") == "signup", "session.commit").otherwise("other")
        status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 17 == 0, 404).when(F.col("event_id") % 5 == 0, 302).otherwise(200)
        return e.select(
            "event_id", "ts", F.concat(F.lit("acct_"), (F.col("user_id") % 3).cast("string")).alias("account_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"),
            op.alias("operation"), status.alias("status_code"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("duration_ms"))

    @property
    def messages(self) -> DataFrame:
        c = self.conversations
        minutes = (F.col("conv_id") % 1000 * 60 + F.col("turn") * ((F.col("conv_id") % 5) * 4 + 1)).cast("int")
        rid = F.when(F.col("role") == "assistant", F.concat(F.lit("r"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")))
        return c.select("conv_id", "turn", "role", "text", (F.lit(T0).cast("timestamp_ntz") + F.make_interval(mins=minutes)).alias("ts"), rid.alias("response_id"), F.concat(F.lit("ch_"), (F.col("conv_id") % 3).cast("string")).alias("channel"))

    @property
    def edges(self) -> DataFrame:
        """Links between documents: ids wrap at the largest id plus seven, so some ends do not exist."""
        d = self.documents.select("doc_id")
        top = d.agg((F.max("doc_id") + 7).alias("top"))
        e = d.crossJoin(F.broadcast(top))  # one row: the largest id
        kinds = F.array(*[F.lit(x) for x in ("related_to", "depends_on", "part_of", "see_also", "related_to", "cites")])
        return e.select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 13 + 1) % F.col("top")).alias("dst"), F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("link_type"), ((F.col("doc_id") % 10) / 10.0).alias("weight"), F.col("doc_id").alias("seq"))


VIEWS_SQL = {
    "ctx": f"""SELECT md5(concat('acct_', doc_id % 3, ':/resources/', source, '/', lang, '/', doc_id, '.md')) AS id, concat('/resources/', source, '/', lang, '/', doc_id, '.md') AS uri,
  concat('/resources/', source, '/', lang) AS parent_uri, concat('acct_', doc_id % 3) AS account_id,
  CASE doc_id % 4 WHEN 0 THEN 'memory' WHEN 1 THEN 'skill' ELSE 'resource' END AS context_type, CAST(doc_id % 3 AS INT) AS level, (doc_id * 37) % 101 AS active_count,
  TIMESTAMP '{T0}' + INTERVAL 1 HOUR * CAST(doc_id % 720 AS INT) AS created_at, TIMESTAMP '{T0}' + INTERVAL 1 HOUR * CAST(doc_id % 720 + 24 AS INT) AS updated_at,
  list_value(concat('lang=', lang), concat('src=', source)) AS search_tags, CAST((doc_id * 7) % 359 - 179 AS DOUBLE) AS lon, CAST((doc_id * 3) % 179 - 89 AS DOUBLE) AS lat,
  lang, source, n_chars, text AS content, doc_id FROM documents""",
    "usage": """SELECT event_id, ts, concat('acct_', user_id % 3) AS account_id, concat('user_', user_id) AS user_id,
  CASE event_type WHEN 'view' THEN 'find' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'add_resource' WHEN 'signup' THEN 'session.commit' ELSE 'other' END AS operation,
  CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 17 = 0 THEN 404 WHEN event_id % 5 = 0 THEN 302 ELSE 200 END AS status_code,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, value AS duration_ms FROM events""",
    "messages": f"""SELECT conv_id, turn, role, text, TIMESTAMP '{T0}' + INTERVAL 1 MINUTE * CAST(conv_id % 1000 * 60 + turn * ((conv_id % 5) * 4 + 1) AS INT) AS ts,
  CASE WHEN role = 'assistant' THEN concat('r', conv_id, '_', turn) END AS response_id, concat('ch_', conv_id % 3) AS channel FROM conversations""",
    "edges": """SELECT doc_id AS src, (doc_id * 13 + 1) % (SELECT max(doc_id) + 7 FROM documents) AS dst,
  list_extract(['related_to', 'depends_on', 'part_of', 'see_also', 'related_to', 'cites'], CAST(doc_id % 6 AS INT) + 1) AS link_type, (doc_id % 10) / 10.0::DOUBLE AS weight, doc_id AS seq FROM documents""",
}


def with_views(sql: str) -> str:
    """DuckDB SQL that may name the derived views: sql is a SELECT, or starts with a comma and further named queries."""
    used = [v for v in VIEWS_SQL if re.search(rf"\b{v}\b", sql)]
    body = sql.strip()
    if not used:
        return "WITH " + body[1:].strip() if body.startswith(",") else body
    head = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    return head + ",\n".join(f"{v} AS ({VIEWS_SQL[v]})" for v in used) + "\n" + body.replace("RECURSIVE", "", 1)
