"""File-system style and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.functions import documents as D
from ctxloom.functions import text as T
from ctxloom.functions import uris
from ctxloom.operators import fsq
from ctxloom.plans.registry import query


def _c(name, sql, f=None):
    if callable(sql):
        query(name)(sql)
    else:
        query(name, sql)(f)


D_ = "len(list_filter(string_split(uri, '/'), lambda x: x <> ''))"
_c("fs_ls", "SELECT uri, substr(content, 1, 256) AS abstract FROM ctx WHERE parent_uri = '/resources/src0/en' ORDER BY uri LIMIT 100", lambda t: fsq.ls(t.ctx, "/resources/src0/en", limit=100).select("uri", F.substring("content", 1, 256).alias("abstract")))
_c("fs_tree", ", d AS (SELECT uri, false AS is_dir FROM ctx UNION SELECT parent_uri, true FROM ctx UNION SELECT '/resources/' || source, true FROM ctx) SELECT uri, is_dir FROM d WHERE starts_with(uri, '/resources/src1') AND (uri = '/resources/src1' OR starts_with(uri, '/resources/src1/')) AND uri <> '/resources/src1'", lambda t: fsq.tree(t.ctx, "/resources/src1", level_limit=3, node_limit=None).select("uri", "is_dir"))
_c("fs_stat_count", "SELECT '/resources/' || source AS uri, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM ctx GROUP BY source", lambda t: t.ctx.groupBy(F.concat(F.lit("/resources/"), "source").alias("uri")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes")))
_c("fs_infer_dirs", "SELECT DISTINCT parent_uri AS uri FROM ctx UNION SELECT DISTINCT '/resources/' || source FROM ctx UNION SELECT '/resources'", lambda t: fsq.inferred_dirs(t.ctx))
_c("fs_glob", "SELECT uri FROM ctx WHERE regexp_matches(uri, '^/resources/src[1-3]/[^/]*/[^/]*3\\.md$')", lambda t: fsq.glob(t.ctx, "/resources/src[1-3]/*/*3.md").select("uri"))
_c("fs_glob_deep", "SELECT uri FROM ctx WHERE regexp_matches(uri, '^/resources/([^/]+/)*de/[^/]*\\.md$')", lambda t: fsq.glob(t.ctx, "/resources/**/de/*.md").select("uri"))
_c("grep_lines", "SELECT uri, line_no, substr(line, 1, 80) AS line FROM (SELECT uri, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM ctx WHERE starts_with(uri, '/resources/src2/')) WHERE regexp_matches(line, '(?i)licen[cs]e|copyright')", lambda t: fsq.grep(t.ctx, "(?i)licen[cs]e|copyright", root="/resources/src2").select("uri", F.col("line_no").cast("long").alias("line_no"), F.substring("line", 1, 80).alias("line")))
_c("fs_rel_depth", f"SELECT doc_id, {D_} - 1 AS depth, substr(uri, 12) AS rel FROM ctx", lambda t: t.ctx.select("doc_id", (uris.depth(F.col("uri")) - 1).cast("long").alias("depth"), uris.relative(F.col("uri"), "/resources").alias("rel")))
_c("read_lines", "SELECT doc_id, array_to_string(list_slice(string_split(content, chr(10)), 2, 3), chr(10)) AS part FROM ctx", lambda t: t.ctx.select("doc_id", fsq.read_lines(F.col("content"), 1, 2).alias("part")))
_c("tool_read", "SELECT doc_id, substr(content, 11, 40) AS part, length(content) > 50 AS more FROM ctx", lambda t: t.ctx.select("doc_id", F.substring("content", 11, 40).alias("part"), (F.length("content") > 50).alias("more")))
_c("tool_search", "SELECT doc_id, instr(lower(content), 'the ') AS at, substr(content, greatest(1, instr(lower(content), 'the ') - 10), 24) AS around FROM ctx WHERE instr(lower(content), 'the ') > 0", lambda t: fsq.search_text(t.ctx, "the ", 10).select("doc_id", F.col("at").cast("long").alias("at"), "around"))
_c("write_modes", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN content || 'new' ELSE 'conflict' END AS out FROM ctx", lambda t: t.ctx.select("doc_id", fsq.written(F.col("content"), F.lit("new"), F.when(F.col("doc_id") % 3 == 0, "replace").when(F.col("doc_id") % 3 == 1, "append").otherwise("create")).alias("out")))
_c("tier_read", "SELECT level, count(*) AS n, min(uri) AS first FROM ctx GROUP BY level", lambda t: t.ctx.groupBy("level").agg(F.count("*").alias("n"), F.min("uri").alias("first")))
_c("read_route", "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN 'backup' END, CASE WHEN doc_id % 3 = 0 THEN 'primary' END, CASE WHEN doc_id % 5 = 0 THEN 'redirect' END, 'miss') AS route FROM ctx", lambda t: t.ctx.select("doc_id", F.coalesce(F.when(F.col("doc_id") % 4 == 0, "backup"), F.when(F.col("doc_id") % 3 == 0, "primary"), F.when(F.col("doc_id") % 5 == 0, "redirect"), F.lit("miss")).alias("route")))

_c("md_frontmatter", "SELECT doc_id, lang || '!' AS lang, source FROM ctx", lambda t: t.ctx.select("doc_id", T.frontmatter(F.concat(F.lit("---\nlang: "), "lang", F.lit("!\nsource: "), "source", F.lit("\n---\n"), "content")).alias("m")).select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source")))
_c("md_tokens", "SELECT doc_id, floor(length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) * 0.3::DOUBLE)::BIGINT AS tokens FROM documents", lambda t: t.documents.select("doc_id", T.markdown_tokens(F.col("text")).alias("tokens")))
_c("token_estimate", "SELECT doc_id, ceil(length(text) * 0.25)::BIGINT AS tokens FROM documents", lambda t: t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens")))
_c("md_slug", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '-', 'g'), '-') AS slug FROM part", lambda t: t.part.select("p_partkey", T.slug(F.concat("p_name", F.lit(" "), "p_type")).alias("slug")))
_c("html_to_text", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages", lambda t: t.pages.select("page_id", T.html_to_text(F.col("html")).alias("text")))
_c("dedupe_body", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))", lambda t: t.documents.groupBy(F.md5(F.lower(T.collapsed(F.col("text")))).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k"))
_c("resource_refs", "SELECT doc_id, 'ctx:/' || uri AS ref FROM ctx WHERE doc_id % 3 <> 0", lambda t: t.ctx.select("doc_id", F.explode(T.references(F.concat(F.lit("see ctx:/"), "uri", F.lit(", `ctx://code/x` ok")))).alias("ref")).where("doc_id % 3 <> 0"))
_c("media_strategy", "SELECT doc_id, CASE WHEN active_count / 100.0 > 0.3 OR active_count >= 50 THEN 'full_page' ELSE 'extract' END AS strategy FROM ctx", lambda t: t.ctx.select("doc_id", F.when((F.col("active_count") / 100.0 > 0.3) | (F.col("active_count") >= 50), "full_page").otherwise("extract").alias("strategy")))
_c("content_type", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' WHEN 3 THEN 'text' ELSE 'other' END AS kind FROM documents", lambda t: t.documents.select("doc_id", T.content_kind(F.concat(F.lit("/a/b."), F.get(F.array(*[F.lit(x) for x in ("PNG", "mp4", "flac", "Md", "bin")]), (F.col("doc_id") % 5).cast("int")))).alias("kind")))
_c("lang_detect", """, w AS (SELECT doc_id, string_split_regex(lower(text), '[^\\p{L}]+') AS w FROM documents), s AS (SELECT doc_id,
  len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'to', 'in', 'is'))) AS en, len(list_filter(w, lambda x: x IN ('der', 'die', 'und', 'das', 'von', 'den'))) AS de,
  len(list_filter(w, lambda x: x IN ('el', 'los', 'que', 'del', 'las', 'por'))) AS es, len(list_filter(w, lambda x: x IN ('le', 'les', 'des', 'est', 'une', 'dans'))) AS fr FROM w)
SELECT doc_id, CASE WHEN greatest(en, de, es, fr) = 0 THEN 'und' WHEN en = greatest(en, de, es, fr) THEN 'en' WHEN de = greatest(en, de, es, fr) THEN 'de' WHEN es = greatest(en, de, es, fr) THEN 'es' ELSE 'fr' END AS lang FROM s""", lambda t: T.language(t.documents.select("doc_id", "text"), "text").select("doc_id", "lang"))
_c("synopsis_text", "SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, substr(text, 1, 60) AS head FROM documents", lambda t: t.documents.select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"), F.substring("text", 1, 60).alias("head")))
_c("json_shape", "SELECT event_id, 'k' AS keys, json_type(props) AS kind FROM events", lambda t: t.events.select("event_id", F.array_join(F.json_object_keys("props"), ",").alias("keys"), F.when(F.json_object_keys("props").isNotNull(), "OBJECT").when(F.json_array_length("props").isNotNull(), "ARRAY").otherwise("VALUE").alias("kind")))
_c("csv_profile", "SELECT count(*) AS rows_, max(len(string_split(line, ','))) AS columns_ FROM (SELECT concat_ws(',', c_custkey, c_mktsegment, c_nationkey) AS line FROM customer)", lambda t: t.customer.select(F.concat_ws(",", "c_custkey", "c_mktsegment", "c_nationkey").alias("line")).agg(F.count("*").alias("rows_"), F.max(F.size(F.split("line", ","))).cast("long").alias("columns_")))
_c("head_tail", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 60) || ' ... ' || right(text, 40) END AS sample FROM documents", lambda t: t.documents.select("doc_id", T.head_tail(F.col("text"), 60, 40).alias("sample")))
_c("clip", "SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE rtrim(substr(text, 1, 47)) || '...' END AS clipped FROM documents", lambda t: t.documents.select("doc_id", T.clip(F.col("text"), 50).alias("clipped")))
_c("tags_normalize", "SELECT doc_id, 'lang=' || lang || ';src=' || source AS tags FROM ctx", lambda t: t.ctx.select("doc_id", F.array_join(T.tags_normalised(F.array(F.concat(F.lit(" LANG="), F.upper("lang")), F.lit("broken"), F.concat(F.lit("src="), "source"), F.concat(F.lit("lang="), "lang"))), ";").alias("tags")))
_c("tags_merge", "SELECT doc_id, 'src=' || source || ';lang=xx' AS tags FROM ctx", lambda t: t.ctx.select("doc_id", F.array_join(T.tags_merged(F.col("search_tags"), F.array(F.lit("lang=xx"))), ";").alias("tags")))
_c("split_list", "SELECT doc_id, unnest(string_split(array_to_string(search_tags, ';'), ';')) AS tag FROM ctx", lambda t: t.ctx.select("doc_id", F.explode(F.split(F.array_join("search_tags", ";"), ";")).alias("tag")))
_c("time_parse", "SELECT event_id, ts::TIMESTAMP AS at, ts - INTERVAL 7 DAY AS week_before FROM events", lambda t: t.events.select("event_id", F.col("ts").cast("string").cast("timestamp_ntz").alias("at"), (F.col("ts") - F.make_interval(days=F.lit(7))).alias("week_before")))
_c("uri_parts", f"SELECT doc_id, parent_uri AS parent, doc_id || '.md' AS leaf, {D_} AS depth, 'md' AS ext FROM ctx", lambda t: t.ctx.select("doc_id", uris.parent(F.col("uri")).alias("parent"), uris.leaf(F.col("uri")).alias("leaf"), uris.depth(F.col("uri")).cast("long").alias("depth"), uris.extension(F.col("uri")).alias("ext")))
_c("uri_classify", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'memory' WHEN lang = 'de' THEN 'skill' ELSE 'resource' END AS kind FROM ctx", lambda t: t.ctx.select("doc_id", F.when(uris.under(F.col("uri"), "/resources/src1") | uris.under(F.col("uri"), "/resources/src2"), "memory").when(F.get(uris.segments(F.col("uri")), 2) == "de", "skill").otherwise("resource").alias("kind")))
_c("record_id", "SELECT doc_id, md5(concat(account_id, ':', uri, CASE level WHEN 0 THEN '/.abstract.md' WHEN 1 THEN '/.overview.md' ELSE '' END)) AS id FROM ctx", lambda t: t.ctx.select("doc_id", uris.record_id(F.col("account_id"), F.col("uri"), F.col("level")).alias("id")))
_c("message_tokens", "SELECT conv_id, sum(ceil(length(coalesce(role, '') || ': ' || coalesce(text, '')) * 0.25))::BIGINT AS tokens FROM messages GROUP BY conv_id", lambda t: t.messages.groupBy("conv_id").agg(F.sum(T.token_estimate(F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))))).alias("tokens")))
_c("fuzzy_similarity", lambda t: fsq.neighbours(t.benchmark))  # DuckDB counts bytes, not letters: a plain version in tests
_c("link_strip", "SELECT doc_id, 'See ' || lang || ' and ' || source || '.' AS text FROM ctx", lambda t: t.ctx.select("doc_id", T.links_stripped(F.concat(F.lit("See ["), "lang", F.lit("](ctx://a) and ["), "source", F.lit("](ctx://b/c)."))).alias("text")))
_c("uri_extract", "SELECT doc_id, 1 AS n FROM ctx", lambda t: t.ctx.select("doc_id", F.size(T.references(F.concat(F.lit("```\nctx://no\n``` ctx:/"), "uri", F.lit(" ctx:/"), "uri"))).alias("n")))
_c("token_f1", """, p AS (SELECT conv_id, turn, role, list_distinct(list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N} \\t\\r\\n]', '', 'g'), '[ \\t\\r\\n]+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))) AS w FROM messages),
j AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS s, len(a.w) AS x, len(b.w) AS y FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, round(CASE WHEN x + y = 0 THEN 0 ELSE 2.0 * s / (x + y) END, 6) AS f1 FROM j""", lambda t: fsq.reply_f1(t.messages))
_c("evidence_recall", "SELECT i.item_id, count(*) AS docs FROM benchmark i JOIN documents d ON contains(d.text, i.text) GROUP BY i.item_id", lambda t: fsq.evidence(t.documents, t.benchmark))
_c("refusal_flag", "SELECT conv_id, turn, regexp_matches(lower(coalesce(text, '')), '(cannot|unable|not able|no information)') AS refused FROM messages WHERE role = 'assistant'", lambda t: t.messages.where("role = 'assistant'").select("conv_id", "turn", F.lower(F.coalesce("text", F.lit(""))).rlike("(cannot|unable|not able|no information)").alias("refused")))

def _order_sheets(t):
    """An XML sheet of each customer with orders: a child for each order, named by whether it is done."""
    o = t.orders.groupBy(F.col("o_custkey").alias("uri")).agg(*[F.collect_list(F.when((F.col("o_orderstatus") == "F") == done, F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")))).alias(tag) for tag, done in (("done", True), ("open", False))])
    return o.select(F.col("uri").cast("string").alias("uri"), F.to_xml(F.struct("done", "open"), {"rowTag": "orders"}).alias("text"))


# document processors: Arrow batches, one row in, rows out
_c("md_headings", "SELECT uri, CAST(1 AS INT) AS line, CAST(1 AS INT) AS level, uri AS title FROM ctx UNION ALL SELECT uri, CAST(len(string_split(content, chr(10))) + 4 AS INT), 2, 'End' FROM ctx UNION ALL SELECT uri, CAST(n + 2 AS INT), length(regexp_extract(l, '^(#{1,6})[ ]', 1)), trim(regexp_extract(l, '^#+[ ]+(.*)', 1), ' #') FROM (SELECT uri, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM ctx) WHERE regexp_matches(l, '^#{1,6}[ ]')", lambda t: D.headings(t.ctx.select("uri", F.concat(F.lit("# "), "uri", F.lit("\n\n"), "content", F.lit("\n\n## End\n")).alias("text"))))
_c("doc_chunks", lambda t: D.chunks(t.documents.select(F.col("doc_id").cast("string").alias("uri"), "text")))
_c("md_sections", lambda t: D.sections(t.ctx.select("uri", F.concat(F.lit("# A\n"), "content", F.lit("\n# B\nshort\n")).alias("text"))))
_c("message_chunks", lambda t: D.message_chunks(t.messages.select(F.concat_ws("-", "conv_id", "turn").alias("uri"), "text")))
_c("binary_sniff", "SELECT CAST(doc_id AS VARCHAR) AS uri, length(substr(text, 1, 4096)) - length(regexp_replace(substr(text, 1, 4096), '[\\x01-\\x08\\x0E-\\x1F]', '', 'g')) > 0.3 * greatest(length(substr(text, 1, 4096)), 1) OR contains(substr(text, 1, 4096), chr(0)) AS is_binary FROM documents", lambda t: D.sniffed(t.documents.select(F.col("doc_id").cast("string").alias("uri"), F.col("text").cast("binary").alias("content"))))
_c("utf8_truncate", 'SELECT CAST(doc_id AS VARCHAR) AS uri, substr(text, 1, list_max(list_filter(range(0, 101), lambda k: strlen(substr(text, 1, k)) <= 100))) AS text FROM documents', lambda t: D.byte_limited(t.documents.select(F.col("doc_id").cast("string").alias("uri"), "text"), 100))
_c("synopsis_kind", "SELECT CAST(event_id AS VARCHAR) AS uri, CASE WHEN json_valid(props) THEN 'json' ELSE 'text' END AS kind FROM events", lambda t: D.kinds(t.events.select(F.col("event_id").cast("string").alias("uri"), F.col("props").alias("text"))))
_c("code_symbols", lambda t: D.code_symbols(t.documents.select(F.col("doc_id").cast("string").alias("uri"), F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("(x):\n    return x\n\nclass A:\n    def m(self): ...\n")).alias("text"))))
_c("patch_apply", lambda t: D.patched(t.documents.select(F.col("doc_id").cast("string").alias("uri"), "text", F.element_at(F.split("text", "\n"), -1).alias("find"), F.lit("PATCHED").alias("put"))))
_c("link_render", lambda t: D.linked(t.documents.select(F.col("doc_id").cast("string").alias("uri"), "text", F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^(\w+)"), F.lit(1))).alias("spans"), F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^(\w+)"), F.lit(1))), lambda x: F.concat(F.lit("ctx://"), x)).alias("targets"))))
_c("redact", lambda t: D.redacted(t.documents.select(F.col("doc_id").cast("string").alias("uri"), "text")))
_c("redact_restore", "SELECT CAST(doc_id AS VARCHAR) AS uri, coalesce(text, '') AS text FROM documents", lambda t: D.restored(D.redacted(t.documents.select(F.col("doc_id").cast("string").alias("uri"), "text"))))
_c("json_repair", lambda t: D.repaired(t.events.select(F.col("event_id").cast("string").alias("uri"), F.concat(F.lit("```json\n"), F.regexp_replace("props", "\\}$", ",}"), F.lit("\n```")).alias("text"))))
_c("xml_children", "SELECT CAST(c_custkey AS VARCHAR) AS uri, tag, CAST(n AS INT) AS n FROM (SELECT o_custkey AS c_custkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS tag, count(*) AS n FROM orders GROUP BY ALL)", lambda t: D.xml_children(_order_sheets(t)))
_c("sheet_to_markdown", "SELECT '| ' || c_custkey || ' | ' || replace(c_mktsegment, '|', chr(92) || '|') || ' |' AS line FROM customer", lambda t: D.sheet_markdown(t.customer.select("c_custkey", "c_mktsegment"), ["c_custkey", "c_mktsegment"]))
