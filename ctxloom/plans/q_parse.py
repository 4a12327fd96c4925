"""Parsers over whole tables: pages as markdown, damaged JSON, unknown encodings, table functions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.functions import documents as D
from ctxloom.functions import registry
from ctxloom.operators import rewrite
from ctxloom.plans.registry import query
from ctxloom.sources import files


@query("html_markdown")
def html_markdown(t):
    return D.as_markdown(t.pages.select(F.col("page_id").cast("string").alias("uri"), "html"))


def damaged(t):
    """(uri, text): a JSON value of each event, broken in one of eight ways."""
    e = t.events.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.array(F.col("user_id"), F.lit(7)).alias("users"), F.from_json("props", "k long").alias("props"))).alias("j"))
    ways = [
        F.concat(F.lit("Here it is:\n```json\n"), "j", F.lit("\n```\nDone.")),
        F.regexp_replace("j", r"[}\]]+$", ""),
        F.regexp_replace("j", r"\}$", ",}"),
        F.translate("j", '"', "'"),
        F.regexp_replace("j", r'"(\w+)":', "$1:"),
        F.regexp_replace("j", r'([\]"\d]),"', '$1 "'),
        F.regexp_replace("j", r"\],", "},"),
        F.concat(F.regexp_replace("j", ",", ", // note\n"), F.lit(" trailing } text")),
    ]
    way = (F.col("event_id") % len(ways)).cast("int")
    return e.select(F.col("event_id").cast("string").alias("uri"), F.get(F.array(*ways), way).alias("text"))


@query("json_repair_damage", "SELECT event_id, event_type AS kind, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_repair_damage(t):
    fixed = D.repaired(damaged(t)).select(F.from_json("json", "id long, kind string, users array<long>, props struct<k: long>").alias("j"))
    return fixed.select(F.col("j.id").alias("event_id"), "j.kind", F.get("j.users", 0).alias("user_id"), "j.props.k")


def encoded(t):
    """(uri, content): each document's bytes in one of six encodings; what Latin-1 lacks is a question mark there."""
    text = F.coalesce("text", F.lit(""))
    plain = F.regexp_replace(text, r"[^\x00-\x7F\xA0-\xFF]", "?")
    ways = [F.encode(text, "UTF-8"), F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")), F.encode(text, "UTF-16LE"), F.encode(text, "UTF-16"), F.encode(plain, "ISO-8859-1"), F.encode(text, "UTF-16BE")]
    way = (F.col("doc_id") % 6).cast("int")
    content = F.when(way == 0, ways[0])
    for k in range(1, 6):
        content = content.when(way == k, ways[k])
    return t.documents.select(F.col("doc_id").cast("string").alias("uri"), content.alias("content"))


@query("encoding_detect", "SELECT doc_id, md5(CASE WHEN doc_id % 6 = 4 THEN regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\x{A0}-\\x{FF}]', '?', 'g') ELSE coalesce(text, '') END) AS md5 FROM documents")
def encoding_detect(t):
    return D.decoded(encoded(t)).select(F.col("uri").cast("long").alias("doc_id"), F.md5("text").alias("md5"))


def _sql(t, text: str):
    registry.install(t.spark)
    return t.spark.sql(text, documents=t.documents, ctx=t.ctx)


@query("udtf_grep", "SELECT doc_id, n AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) WHERE regexp_matches(line, '(?i)licen[cs]e|copyright')")
def udtf_grep(t):
    return _sql(t, "SELECT d.doc_id, CAST(g.line_no AS BIGINT) AS line_no, g.line FROM {documents} d, LATERAL ctx_grep(d.text, '(?i)licen[cs]e|copyright') g")


@query("udtf_headings", "SELECT doc_id, 1 AS line, 1 AS level, uri AS title FROM ctx UNION ALL SELECT doc_id, 3, 2, lang FROM ctx")
def udtf_headings(t):
    return _sql(t, "SELECT c.doc_id, h.* FROM {ctx} c, LATERAL ctx_headings(concat('# ', c.uri, '\n\n## ', c.lang, '\n', c.content)) h")


@query("udtf_chunks")
def udtf_chunks(t):
    return _sql(t, "SELECT d.doc_id, c.chunk, c.text FROM {documents} d, LATERAL ctx_chunks(d.text, 256) c")


def outlined(t):
    """(uri, text): each document with every seventh line a heading, and every third of those a higher one."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i % 21 == 7, "# ").when(i % 7 == 0, "## ").otherwise(""), x))
    return t.documents.select(F.col("doc_id").cast("string").alias("uri"), F.array_join(lines, "\n").alias("text"))


@query("md_section_tree")
def md_section_tree(t):
    return D.section_trees(outlined(t), 512, 128)


def linked(t):
    """(uri, text): the context's files with links to the files that edges name, to one that isn't there, and to a page."""
    c = t.ctx.select("doc_id", "uri", "parent_uri", F.coalesce("content", F.lit("")).alias("content"))
    to = t.edges.join(c.select(F.col("doc_id").alias("dst"), F.col("uri").alias("target")), "dst").select(F.col("src").alias("doc_id"), "target")
    up = F.concat(F.lit("../../"), F.regexp_extract("target", "^/resources/(.*)$", 1))
    return c.join(to, "doc_id", "left").select("doc_id", "uri", "target", F.concat("content", F.coalesce(F.concat(F.lit("\nSee [it]("), up, F.lit("#part)")), F.lit("")), F.lit("\n[gone](../nothing.md) [web](https://a.b/c.md)")).alias("text"))


@query("md_link_rewrite", """SELECT c.doc_id, coalesce(c.content, '') || CASE WHEN d.uri IS NULL THEN '' ELSE chr(10) || 'See [it](../../../' || regexp_replace(substr(d.uri, 12), '[.]md$', '') || '/#part)' END || chr(10) || '[gone](../nothing.md) [web](https://a.b/c.md)' AS text
FROM ctx c LEFT JOIN edges e ON e.src = c.doc_id LEFT JOIN ctx d ON d.doc_id = e.dst""")
def md_link_rewrite(t):
    """Every file becomes a folder of its name, and links to files follow."""
    return rewrite.moved_into_folders(linked(t).select("uri", "doc_id", "text"), t.ctx.select("uri")).select("doc_id", "text")


def feeds(t):
    """(host, feed, xml): RSS documents of at most a hundred pages of a host."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1))
    item = F.struct(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("url").alias("link"))
    group = t.pages.where(F.col("url").isNotNull()).groupBy(host.alias("host"), F.floor(F.col("page_id") / 100).alias("feed")).agg(F.collect_list(item).alias("item"))
    return group.select("host", "feed", F.to_xml(F.struct(F.struct(F.col("host").alias("title"), "item").alias("channel")), {"rowTag": "rss"}).alias("xml"))


@query("feed_parse", "SELECT lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS host, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, url AS link FROM pages WHERE url IS NOT NULL")
def feed_parse(t):
    items = feeds(t).select("host", F.explode(files.feed_items(F.col("xml"))).alias("i"))
    return items.select("host", F.coalesce("i.title", F.lit("")).alias("title"), "i.link")


@query("sort_nulls_last", "SELECT page, k, event_id FROM (SELECT event_id // 1000 AS page, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY k DESC NULLS LAST, event_id) AS r FROM events) WHERE r <= 5 OR r > 995")
def sort_nulls_last(t):
    """The first and last rows of each thousand, values from high to low and missing ones at the end."""
    from pyspark.sql import Window

    e = t.events.select(F.floor(F.col("event_id") / 1000).alias("page"), "event_id", F.when(F.col("event_id") % 3 != 0, F.get_json_object("props", "$.k").cast("long")).alias("k"))
    r = e.withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy(F.desc_nulls_last("k"), "event_id")))
    return r.where("r <= 5 OR r > 995").select("page", "k", "event_id")
