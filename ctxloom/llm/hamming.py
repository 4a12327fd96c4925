"""Exact top-k search in binary codes by incremental multi-index hashing.

A vector's 64-bit code holds the signs of its components. Equal codes are one code with its ids (a
top-k result needs its k least ids only). Codes are cut into segments; an index row is (segment,
value, code). In round r every open query looks up, in each segment, all values that differ from its
own in r bits. By the pigeonhole principle all codes within segments * (r + 1) - 1 bits are then
found, so a query is done once its k-th verified distance is no larger; ties at that distance are all
found too and break by id. Until then its k-th distance so far bounds the candidates that the join
passes on, so a hot bucket yields little. The first bound comes from k codes of each bucket.

Rows with a null vector have no code and are not found; repeated ids are rows of their own; k beyond
the table's rows gives all rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.llm import _base as B

K = 10
BITS = 64


def binary_code(vector) -> F.Column:
    """Signs of up to 64 components (bit i of the code is component i > 0); later ones add to component i mod 64."""
    folded = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(vector) - 1) / BITS).cast("int"))), F.array_repeat(F.lit(0.0), BITS),
        lambda acc, part: F.transform(acc, lambda x, i: x + F.coalesce(F.get(vector, part * BITS + i).cast("double"), F.lit(0.0))))
    folded = F.when(F.size(vector) <= BITS, F.transform(vector, lambda x: x.cast("double"))).otherwise(folded)
    bits = F.transform(folded, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(vector.isNotNull(), code)


def n_segments(n: int) -> int:
    """Segments of about log2(n) bits, and no more than four."""
    return 4 if n <= 1 << 20 else 3 if n <= 1 << 27 else 2


def _masks(width: int, r: int) -> F.Column:
    """All width-bit masks of r bits, as a constant."""
    return F.split(F.lit(",".join(str(sum(1 << b for b in bits)) for bits in combinations(range(width), r))), ",").cast("array<long>")


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows of each query, by (distance, id). rows, queries: id, code."""
    rows, queries = (x.select("id", "code").where(F.col("code").isNotNull()) for x in (rows, queries))
    nth = F.row_number().over(Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last()))
    codes = rows.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("code").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("ids"))
    codes = B.keep(codes.select("code", "ids", F.size("ids").alias("n"), F.get("ids", 0)["none"].alias("none"), F.get("ids", 0)["id"].alias("least")), "codes")
    total = codes.count()
    m = n_segments(total)
    edge = [BITS * i // m for i in range(m + 1)]
    widths = [b - a for a, b in zip(edge, edge[1:])]
    value = lambda i: F.shiftrightunsigned("code", edge[i]).bitwiseAND(F.lit((1 << widths[i]) - 1).cast("long"))
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), value(i).alias("value")) for i in range(m)])).alias("s")
    index = B.keep(codes.select("code", "n", "none", "least", parts).select("s.seg", "s.value", "code", "n", "none", "least"), "index")
    dist = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
    asked = queries.select(F.col("code").alias("q")).distinct()
    few = index.withColumn("nth", F.row_number().over(Window.partitionBy("seg", "value").orderBy("none", "least", "code"))).where(F.col("nth") <= k).drop("nth")

    def ranked(found: DataFrame) -> DataFrame:
        """The k best codes of each query, with the distance that its k-th id has so far."""
        order = Window.partitionBy("q").orderBy("dist", "none", "least", "code")
        found = found.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        found = found.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        bound = F.min(F.when(F.col("upto") >= k, F.col("dist"))).over(Window.partitionBy("q"))
        return found.withColumn("bound", bound).drop("nth", "upto")

    split = asked.withColumn("code", F.col("q")).select("q", parts).select("q", "s.seg", "s.value")
    split = B.keep(split, "queries")
    best = B.keep(ranked(split.join(few, ["seg", "value"]).select("q", "code", "n", "none", "least", dist.alias("dist"))), "best")
    open_ = B.keep(asked.join(best.groupBy("q").agg(F.first("bound").alias("bound")), "q", "left"), "open")
    done = None
    for r in range(max(widths) + 1):
        probe = None
        for i, w in enumerate(widths):
            if r <= w:
                p = split.where(F.col("seg") == i).join(open_, "q").select("q", "seg", "bound", F.explode(F.transform(_masks(w, r), lambda x: x.bitwiseXOR(F.col("value")))).alias("value"))
                probe = p if probe is None else probe.unionByName(p)
        near = probe.join(index, ["seg", "value"]).where(dist <= F.coalesce("bound", F.lit(BITS))).select("q", "code", "n", "none", "least", dist.alias("dist"))
        last = best
        best = B.keep(ranked(best.join(open_.select("q"), "q", "left_semi").drop("bound").unionByName(near)), "best")
        covered = m * (r + 1) - 1
        ready = (F.col("bound") <= covered) if r < max(widths) else F.lit(True)
        out = best.where(F.coalesce(ready, F.lit(False)))
        done = out if done is None else done.unionByName(out)
        if r == max(widths):
            break
        state = best.groupBy("q").agg(F.first("bound").alias("bound"), F.count("*").alias("found"))
        # with fewer than k rows in the table a query ends when it has met every code
        rest = open_.select("q").join(state, "q", "left").where(F.col("bound").isNull() | (F.col("bound") > covered))
        open_ = B.keep(rest.select("q", "bound"), "open")
        if open_.isEmpty():
            break
        del last
    ids = codes.select("code", "ids")
    pairs = queries.select(F.col("id").alias("query_id"), F.monotonically_increasing_id().alias("row"), F.col("code").alias("q")).join(done.select("q", "code", "dist"), "q").join(ids, "code")
    hit = pairs.select("query_id", "row", F.col("dist").alias("distance"), F.explode("ids").alias("x")).select("query_id", "row", "distance", "x.none", "x.id")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy("distance", "none", "id"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("distance").cast("int").alias("distance"))


def op3(spark, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), binary_code(F.col("embedding")).alias("code"))
    return search(rows, rows.where(F.col("id") % 20 == 0)).withColumnRenamed("id", "vec_id")


SQL = f"""
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: CASE WHEN p[1] = p[2] THEN 0 ELSE 1 END))::INT AS distance
      FROM c q, c WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM r WHERE rank <= {K}
"""
