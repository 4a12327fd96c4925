"""Vector search queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ctxloom.operators import vectors as V
from ctxloom.plans.registry import query

def _e():
    return F.col("embedding")


def _q():
    return F.col("query")


QUERY0 = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
SRC = f"SELECT vec_id, label, embedding::DOUBLE[] AS e, q FROM embeddings, {QUERY0}"
DOT = "list_inner_product(e, q)"
L2 = "list_sum(list_transform(list_zip(e, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
COS = "list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)))"


def _q0(t, rows=None):
    return V.one_query(t.embeddings if rows is None else rows, t.embeddings.where("vec_id = 0"))


def _ranked(expr: str, where: str = "true", k: int = 10, src: str = SRC) -> str:
    return f"SELECT vec_id, round({expr}, 6) AS score FROM ({src}) WHERE {where} ORDER BY round({expr}, 6) DESC, vec_id DESC LIMIT {k}"


for kind, sql in (("ip", DOT), ("l2", f"1 - {L2}"), ("cosine", COS)):
    query(f"knn_{kind}", _ranked(sql))(lambda t, kind=kind: V.top(_q0(t).select("vec_id", V.score(kind, _e(), _q()).alias("score")), 10))


@query("knn_int8", f"""SELECT vec_id, round(s * sa * sb, 6) AS score FROM (
  SELECT vec_id, sa, sb, list_sum(list_transform(list_zip(list_transform(e, lambda x: greatest(-127, least(127, round(x / sa)))), list_transform(q, lambda x: greatest(-127, least(127, round(x / sb))))), lambda p: p[1] * p[2])) AS s
  FROM (SELECT *, list_max(list_transform(e, lambda x: abs(x))) / 127.0::DOUBLE AS sa, list_max(list_transform(q, lambda x: abs(x))) / 127.0::DOUBLE AS sb FROM ({SRC}))) ORDER BY round(s * sa * sb, 6) DESC, vec_id DESC LIMIT 10""")
def knn_int8(t):
    d = _q0(t).withColumn("sa", V.int8_scale(_e())).withColumn("sb", V.int8_scale(_q()))
    return V.top(d.select("vec_id", V.int8_dot(V.int8_codes(_e(), F.col("sa")), F.col("sa"), V.int8_codes(_q(), F.col("sb")), F.col("sb")).alias("score")), 10)


# sparse vectors: counts of all words of a text
def _terms(t):
    return t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("term"))


def _asked(t):
    """(term, m): the query's terms, here those of document 0."""
    return _terms(t).where("doc_id = 0").groupBy("term").agg(F.count("*").cast("double").alias("m"))


def _dots(t):
    """(doc_id, sparse): each occurrence of a query's term adds the term's weight; no document becomes a vector of its own."""
    return _terms(t).join(_asked(t), "term", "left").groupBy("doc_id").agg(F.sum(F.coalesce("m", F.lit(0.0))).alias("sparse"))


TERMS = """, w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM documents),
sv AS (SELECT doc_id, term, count(*)::DOUBLE AS n FROM w GROUP BY ALL), q AS (SELECT term, n AS m FROM sv WHERE doc_id = 0)"""
SPARSE = TERMS + """, s AS (SELECT doc_id, coalesce(sum(n * m), 0.0) AS sparse FROM sv LEFT JOIN q USING (term) GROUP BY doc_id)"""


@query("knn_sparse", SPARSE + " SELECT doc_id, round(sparse, 6) AS score FROM s ORDER BY score DESC, doc_id DESC LIMIT 10")
def knn_sparse(t):
    return V.top(_dots(t).withColumnRenamed("sparse", "score"), 10, "doc_id")


@query("knn_sparse_l2", SPARSE + """, n2 AS (SELECT doc_id, sum(n * n) AS nn FROM sv GROUP BY doc_id), q2 AS (SELECT sum(m * m) AS qq FROM q)
SELECT doc_id, round(1 - (nn + qq - 2 * sparse), 6) AS score FROM s JOIN n2 USING (doc_id), q2 ORDER BY score DESC, doc_id DESC LIMIT 10""")
def knn_sparse_l2(t):
    n, m = F.col("n"), F.coalesce("m", F.lit(0.0))
    counts = _terms(t).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("n")).join(_asked(t), "term", "left")
    # over a text's own terms the squared distance is less than the query's square by what those terms hold of it
    near = counts.groupBy("doc_id").agg(F.sum((n - m) * (n - m) - m * m).alias("own"))
    whole = _asked(t).agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0)).alias("qq"))
    return V.top(near.crossJoin(F.broadcast(whole)).select("doc_id", (1 - F.col("own") - F.col("qq")).alias("score")), 10, "doc_id")  # one row


@query("knn_sparse_only", SPARSE + " SELECT doc_id, round(sparse, 6) AS score FROM s WHERE sparse > 0 ORDER BY score DESC, doc_id DESC LIMIT 15")
def knn_sparse_only(t):
    return V.top(_terms(t).join(_asked(t), "term").groupBy("doc_id").agg(F.sum("m").alias("score")), 15, "doc_id")


def _both(t):
    s = _dots(t)
    d = _q0(t).select(F.col("vec_id").alias("doc_id"), V.dot(_e(), _q()).alias("dense"))
    return d.join(s, "doc_id")


BOTH = SPARSE + f", d AS (SELECT vec_id AS doc_id, {DOT} AS dense FROM ({SRC})), b AS (SELECT * FROM d JOIN s USING (doc_id))"


@query("knn_hybrid", BOTH + " SELECT doc_id, round(dense * 0.7::DOUBLE + sparse * 0.3::DOUBLE, 6) AS score FROM b ORDER BY score DESC, doc_id DESC LIMIT 10")
def knn_hybrid(t):
    return V.top(_both(t).select("doc_id", V.hybrid(F.col("dense"), F.col("sparse"), 0.3).alias("score")), 10, "doc_id")


@query("knn_hybrid_sum", BOTH + " SELECT doc_id, round(dense + sparse, 6) AS score FROM b ORDER BY score DESC, doc_id DESC LIMIT 10")
def knn_hybrid_sum(t):
    return V.top(_both(t).select("doc_id", (F.col("dense") + F.col("sparse")).alias("score")), 10, "doc_id")


@query("knn_rrf", BOTH + """, rd AS (SELECT doc_id, row_number() OVER (ORDER BY round(dense, 6) DESC, doc_id DESC) AS r FROM b ORDER BY r LIMIT 40), rs AS (SELECT doc_id, row_number() OVER (ORDER BY round(sparse, 6) DESC, doc_id DESC) AS r FROM b ORDER BY r LIMIT 40)
SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + rd.r), 0) + coalesce(1.0::DOUBLE / (60 + rs.r), 0), 6) AS score FROM rd FULL JOIN rs USING (doc_id) ORDER BY score DESC, doc_id DESC LIMIT 10""")
def knn_rrf(t):
    b = _both(t)
    rank = lambda c: V.top(b.select("doc_id", F.col(c).alias("score")), 40, "doc_id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("doc_id"))))  # noqa: E731  forty rows
    return V.top(V.rrf(rank("dense"), rank("sparse"), "doc_id"), 10, "doc_id")


@query("dist_to_score", f"SELECT vec_id, round(-({DOT}), 6) AS ip_score, round(1 / (1 + greatest({L2}, 0)), 6) AS l2_score FROM ({SRC})")
def dist_to_score(t):
    return _q0(t).select("vec_id", F.round(V.distance_to_score("ip", V.dot(_e(), _q())), 6).alias("ip_score"), F.round(V.distance_to_score("l2", V.l2_squared(_e(), _q())), 6).alias("l2_score"))


@query("knn_filtered", f"SELECT vec_id, uri, round({COS}, 6) AS score FROM ({SRC}) JOIN ctx ON vec_id = doc_id WHERE lang = 'en' ORDER BY score DESC, vec_id DESC LIMIT 10")
def knn_filtered(t):
    rows = t.embeddings.join(t.ctx.where("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "uri"), "vec_id")
    best = V.top(_q0(t, rows).select("vec_id", V.cosine(_e(), _q()).alias("score")), 10)
    return best.join(t.ctx.select(F.col("doc_id").alias("vec_id"), "uri"), "vec_id").select("vec_id", "uri", "score")  # wide columns only for the ten


@query("knn_by_id", f"SELECT vec_id, round({DOT}, 6) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e, q FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 42)) ORDER BY score DESC, vec_id DESC LIMIT 10")
def knn_by_id(t):
    return V.top(V.one_query(t.embeddings, t.embeddings.where("vec_id = 42")).select("vec_id", V.dot(_e(), _q()).alias("score")), 10)


@query("knn_random")
def knn_random(t):
    q = t.spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.xxhash64(i) % 1000000) / 1000000.0).alias("embedding"))
    return V.top(V.one_query(t.embeddings, q).select("vec_id", V.dot(_e(), _q()).alias("score")), 10)


@query("keyword_match", "SELECT doc_id, len(list_filter(string_split(lower(text), ' '), lambda x: x IN ('the', 'und', 'les'))) AS hits FROM documents WHERE len(list_filter(string_split(lower(text), ' '), lambda x: x IN ('the', 'und', 'les'))) > 0 ORDER BY hits DESC, doc_id LIMIT 20")
def keyword_match(t):
    hits = F.size(F.filter(F.split(F.lower("text"), " "), lambda x: x.isin("the", "und", "les"))).cast("long")
    return t.documents.select("doc_id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(20)


@query("knn_batch", """SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 5""")
def knn_batch(t):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), _e().alias("query"))
    return V.batch_knn(t.embeddings, q, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@query("vec_truncate_norm", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS total, round(e[1] / n, 6) AS first FROM (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, list_slice(embedding, 1, 16)::DOUBLE[] AS e FROM embeddings))")
def vec_truncate_norm(t):
    v = V.truncated(_e(), 16)
    return t.embeddings.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get(v, 0), 6).alias("first"))


@query("knn_label_vote", f"SELECT label, count(*) AS n, round(max({DOT}), 6) AS best FROM ({SRC}) GROUP BY label")
def knn_label_vote(t):
    return _q0(t).groupBy("label").agg(F.count("*").alias("n"), F.round(F.max(V.dot(_e(), _q())), 6).alias("best"))
