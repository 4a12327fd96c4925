"""Filter, projection, sort and limit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.functions import uris
from ctxloom.operators import dsl
from ctxloom.operators.dsl import And, Contains, Eq, In, Or, PathScope, Range, Raw, TimeRange
from ctxloom.plans.registry import query

IDS = "SELECT doc_id, uri FROM ctx WHERE "


def _filter(name: str, node, sql: str):
    query(name, IDS + sql)(lambda t: dsl.where(t.ctx, dsl.lower(node)).select("doc_id", "uri"))


ROOT = "/resources/src0"
must = lambda f, *c, **k: {"op": "must", "field": f, "conds": list(c), **k}
not_ = lambda f, *c, **k: {"op": "must_not", "field": f, "conds": list(c), **k}
SUB = f"(uri = '{ROOT}' OR starts_with(uri, '{ROOT}/'))"
DEPTH = "len(list_filter(string_split(uri, '/'), lambda x: x <> ''))"

_filter("f_must", must("lang", "en", "de"), "lang IN ('en', 'de')")
_filter("f_must_list", must("search_tags", "lang=en", "src=src3"), "list_contains(search_tags, 'lang=en') OR list_contains(search_tags, 'src=src3')")
_filter("f_path_subtree", must("uri", ROOT), SUB)
for n in (0, 1, 2):
    _filter(f"f_path_depth{n}", must("uri", ROOT + "/en" if n == 1 else ROOT, para=f"-d={n}"), (f"(uri = '{ROOT}/en' OR starts_with(uri, '{ROOT}/en/')) AND {DEPTH} <= 4" if n == 1 else f"{SUB} AND {DEPTH} <= {2 + n}"))
_filter("f_path_root", must("uri", "/"), "true")
_filter("f_must_not", not_("lang", "en", "fr"), "lang NOT IN ('en', 'fr')")
_filter("f_path_must_not", not_("uri", ROOT), f"NOT {SUB}")
_filter("f_range", {"op": "range", "field": "n_chars", "gte": 500, "lt": 2000}, "n_chars >= 500 AND n_chars < 2000")
_filter("f_range_center", {"op": "range", "field": "active_count", "center": [50], "radius": 10}, "active_count BETWEEN 40 AND 60")
_filter("f_range_out", {"op": "range_out", "field": "active_count", "gte": 20, "lt": 80}, "active_count < 20 OR active_count >= 80")
_filter("f_geo_range", {"op": "geo_range", "field": "geo", "center": "10,10", "radius": "2000km"}, "(lon - 10) * (lon - 10) + (lat - 10) * (lat - 10) <= (2000000.0 / 111320.0) * (2000000.0 / 111320.0)")
_filter("f_time_range", {"op": "time_range", "field": "created_at", "gt": "2024-01-05 12:00:00", "lte": "2024-01-20 00:00:00"}, "created_at > TIMESTAMP '2024-01-05 12:00:00' AND created_at <= TIMESTAMP '2024-01-20 00:00:00'")
_filter("f_timerange_ast", TimeRange("created_at", "2024-01-05 00:00:00", "2024-01-06 00:00:00"), "created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-06'")
_filter("f_prefix", {"op": "prefix", "field": "uri", "prefix": "resources/src1"}, "starts_with(uri, '/resources/src1')")
_filter("f_contains", {"op": "contains", "field": "content", "substring": "the"}, "contains(content, 'the')")
_filter("f_regex", {"op": "regex", "field": "uri", "pattern": "/(en|de)/[0-9]*7\\.md$"}, "regexp_matches(uri, '/(en|de)/[0-9]*7\\.md$')")
_filter("f_regex_bad", {"op": "regex", "field": "uri", "pattern": "(unclosed"}, "false")
query("f_label_in", IDS + "doc_id IN (1, 5, 9, 1000000)")(lambda t: dsl.where(t.ctx, {"op": "label_in", "labels": [1, 5, 9, 1000000]}, dsl.Schema(key="doc_id")).select("doc_id", "uri"))
_filter("f_and", {"op": "and", "conds": [must("lang", "en"), {"op": "range", "field": "active_count", "gt": 30}]}, "lang = 'en' AND active_count > 30")
_filter("f_and_empty", {"op": "and", "conds": [must("lang", "en"), {}]}, "false")
_filter("f_and_ignore_empty", {"op": "and", "ignore_empty_condition": True, "conds": [must("lang", "en"), {}, {"op": "or", "conds": []}]}, "lang = 'en'")
_filter("f_or", {"op": "or", "conds": [must("lang", "fr"), {}, {"op": "range", "field": "active_count", "lt": 10}]}, "lang = 'fr' OR active_count < 10")
_filter("f_eq_uri", Eq("uri", ROOT + "/en/820.md"), f"uri = '{ROOT}/en/820.md'")
_filter("f_ast_mix", And((Or((Eq("lang", "en"), In("source", ("src3", "src4")))), Range("n_chars", gte=200), Contains("content", "a"), PathScope("uri", "/resources", 3), Raw({"op": "must_not", "field": "context_type", "conds": ["memory"]}))), "(lang = 'en' OR source IN ('src3', 'src4')) AND n_chars >= 200 AND contains(content, 'a') AND " + DEPTH + " <= 4 AND context_type <> 'memory'")
_filter("f_noop", {"op": "or", "conds": []}, "false")
_filter("f_bool_num_mix", {"op": "and", "conds": [{"op": "or", "conds": [must("level", 0, 2), {"op": "prefix", "field": "source", "prefix": "src1"}]}, not_("search_tags", "lang=de")]}, "(level IN (0, 2) OR starts_with(source, 'src1')) AND NOT list_contains(search_tags, 'lang=de')")


# ---------------------------------------------------------------- projection, sort, limit

@query("project_fields", "SELECT doc_id, uri, lang, active_count FROM ctx")
def project_fields(t):
    return t.ctx.select("doc_id", "uri", "lang", "active_count")


@query("uri_encode", "SELECT doc_id, '/' || trim(replace('ctx:/' || uri || '/', 'ctx://', ''), '/') AS path FROM ctx")
def uri_encode(t):
    return t.ctx.select("doc_id", uris.encoded(F.concat(F.lit("ctx:/"), "uri", F.lit("/"))).alias("path"))


@query("uri_decode", "SELECT doc_id, 'ctx://' || trim(uri, '/') AS full_uri FROM ctx")
def uri_decode(t):
    return t.ctx.select("doc_id", uris.decoded(F.col("uri")).alias("full_uri"))


@query("sort_topk_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_topk_desc(t):
    return dsl.sort_rows(t.orders, "o_totalprice", topk=20, tie="o_orderkey").select("o_orderkey", "o_totalprice")


@query("sort_topk_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def sort_topk_asc(t):
    return dsl.sort_rows(t.orders, "o_totalprice", "asc", 20, tie="o_orderkey").select("o_orderkey", "o_totalprice")


@query("sort_multi", "SELECT doc_id, active_count, n_chars FROM ctx ORDER BY active_count DESC, n_chars, doc_id LIMIT 50")
def sort_multi(t):
    return dsl.sort_rows(t.ctx, ["active_count", "n_chars"], ["desc", "asc"], 50, tie="doc_id").select("doc_id", "active_count", "n_chars")


@query("sort_center1d", "SELECT doc_id, active_count FROM ctx ORDER BY abs(active_count - 50), active_count, doc_id LIMIT 30")
def sort_center1d(t):
    return dsl.sort_rows(t.ctx, "active_count", center=50, topk=30, tie="doc_id").select("doc_id", "active_count")


@query("sort_geo_center", "SELECT doc_id, lon, lat FROM ctx ORDER BY (lon - 5) * (lon - 5) + (lat - 5) * (lat - 5), doc_id LIMIT 15")
def sort_geo_center(t):
    return t.ctx.orderBy((F.col("lon") - 5) * (F.col("lon") - 5) + (F.col("lat") - 5) * (F.col("lat") - 5), "doc_id").limit(15).select("doc_id", "lon", "lat")


@query("search_scalar", "SELECT doc_id, CAST(n_chars AS DOUBLE) AS score FROM ctx ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 5")
def search_scalar(t):
    return dsl.sort_rows(t.ctx, "n_chars", topk=10, tie="doc_id", offset=5).select("doc_id", F.col("n_chars").cast("double").alias("score"))


@query("limit_offset", "SELECT doc_id, uri FROM ctx ORDER BY doc_id LIMIT 25 OFFSET 50")
def limit_offset(t):
    return t.ctx.select("doc_id", "uri").orderBy("doc_id").offset(50).limit(25)


@query("filter_sort_topk", "SELECT doc_id, active_count FROM ctx WHERE lang = 'en' ORDER BY active_count DESC, doc_id LIMIT 12")
def filter_sort_topk(t):
    return dsl.sort_rows(dsl.where(t.ctx, must("lang", "en")), "active_count", topk=12, tie="doc_id").select("doc_id", "active_count")
