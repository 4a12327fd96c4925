"""The nearest rows of many queries, all pairs compared.

Rows and queries are dealt into cells of a bounded size, a task a cell, and none is collected. In a cell, products of
matrices rule out what can't be among the best of a query; what is left is scored again one component after the other, as a sum in
SQL is, and rounded before it is ranked, so ties and results are those of scoring every pair that way. Of equal vectors only as many as can be returned are compared.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bytes of vectors of a cell, of rows and of queries each, and comparisons of a cell beside which more tasks don't pay.
CELL_BYTES, CELL_PAIRS = 8 << 20, 1 << 24
#: Queries and rows that are compared by one product.
QUERIES, ROWS = 512, 4096
#: Scores are ranked by so many decimal places.
PLACES = 6


def rounded(x: np.ndarray) -> np.ndarray:
    """Half up by the decimal digits of the number, as Spark's round()."""
    y = np.abs(x) * 10.0**PLACES
    out = np.where(np.abs(x) < 1e11, np.copysign(np.floor(y + 0.5), x) / 10.0**PLACES, x)
    for i in np.flatnonzero((np.abs(y - np.floor(y) - 0.5) <= 1e-6 + y * 1e-15) & (np.abs(x) < 1e11)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-PLACES), ROUND_HALF_UP))
    return out


def _exact(kind: str, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of the pairs (row i, query j) by sums in the order of the components, which are the first axis of a and b; not finite ones are 0."""
    s = np.zeros(len(i))
    for x, y in zip(a, b):
        s += (x[i] - y[j]) ** 2 if kind == "l2" else x[i] * y[j]
    if kind == "l2":
        s = 1 - s
    elif kind == "cosine":
        n = np.sqrt(na[i]) * np.sqrt(nb[j])
        s = np.where(n > 0, s / np.where(n > 0, n, 1.0), 0.0)
    return np.where(np.isfinite(s), s, 0.0)


def _squares(a: np.ndarray) -> np.ndarray:
    s = np.zeros(a.shape[1])
    for x in a:
        s += x * x
    return s


def _matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(one column per vector, which of them are usable): those of another length or with missing or infinite components are zeros."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(vectors.filter(pa.array(ok))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(ok.sum()), size)
    good = np.isfinite(flat).all(axis=1)
    ok[ok] = good
    out = np.zeros((size, len(ok)))
    out[:, ok] = flat[good].T
    return out, ok


def _distinct(a: np.ndarray, ok: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first rows by order of each vector; those that aren't usable count as one vector."""
    at, kind = np.flatnonzero(ok), np.full(len(ok), -1)
    if len(at) and len(a):
        rows = np.ascontiguousarray(a[:, at].T)
        kind[at] = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    elif len(at):
        kind[at] = 0
    return np.sort(_first(kind, (-order,), k))


def _first(group: np.ndarray, by: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Positions of the k first of each group, sorted by group and by `by`, of which the last counts most."""
    s = np.lexsort((*by, group))
    g = group[s]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return s[place < k]


def best(vectors: pa.Array, queries: pa.Array, order: np.ndarray, k: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of the k best rows of each query. order: of equal scores the row with the largest comes first."""
    sizes = pc.fill_null(pc.list_value_length(queries), -1).to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        found = _best_of_size(vectors, queries.take(pa.array(at)), max(int(size), 0), order, k, kind, size < 0)
        out.append((found[0], at[found[1]], found[2]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _best_of_size(vectors: pa.Array, queries: pa.Array, size: int, order: np.ndarray, k: int, kind: str, missing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, ok = _matrix(vectors, size)
    b, asked = _matrix(queries, size)
    if missing:
        ok[:] = False
    some = _distinct(a, ok, order, k)
    a, ok, order = np.ascontiguousarray(a[:, some]), ok[some], order[some]
    with np.errstate(all="ignore"):
        na, nb = _squares(a), _squares(b)
        # products of these may leave the range of doubles, so they are all scored again
        odd = lambda n: (n != 0) & ~((n > 1e-280) & (n < 1e280))
        odd_a, odd_b = odd(na), odd(nb)
        unit = lambda v, n: v / np.where(n > 0, np.sqrt(n), 1.0) if kind == "cosine" else v
        left, right = unit(a, na), unit(b, nb)
        reach = (np.ones(len(nb)) if kind == "cosine" else (np.sqrt(nb) + np.sqrt(na[~odd_a].max(initial=0.0))) ** 2) + 1.0
        spare = 10.0**-PLACES + reach * (size + 8) * 1e-15
        found = []
        for low in range(0, len(nb), QUERIES):
            q = slice(low, low + QUERIES)
            row, query, score, mark = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)
            n = len(nb[q])
            bar = np.full(n, -np.inf)
            for lo in range(0, len(na), ROWS):
                r = slice(lo, lo + ROWS)
                about = right[:, q].T @ left[:, r]
                if kind == "l2":
                    about = 1.0 - (nb[q, None] + na[None, r] - 2.0 * about)
                about[:, ~ok[r]] = 0.0
                about[~asked[q]] = 0.0
                if odd_a[r].any() or odd_b[q].any():
                    about[odd_b[q, None] | odd_a[None, r]] = np.inf
                elif lo == 0 and about.shape[1] > k:
                    bar = np.partition(about, -k, axis=1)[:, -k] - 2 * spare[q]
                j, i = np.nonzero(about >= bar[:, None])
                new = np.where(ok[i + lo] & asked[j + low], _exact(kind, a, b, na, nb, i + lo, j + low), 0.0)
                row, query, score, mark = np.r_[row, i + lo], np.r_[query, j], np.r_[score, new], np.r_[mark, rounded(new)]
                keep = _first(query, (-order[row], -mark), k)
                row, query, score, mark = row[keep], query[keep], score[keep], mark[keep]
                # below the last of k results nothing can come in any more
                full = np.bincount(query, minlength=n) >= k
                last = np.full(n, np.inf)
                np.minimum.at(last, query, mark)
                bar = np.where(full, last - spare[q], bar)
            found.append((some[row], query + low, score))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _one(table: pa.Table, name: str) -> pa.Array:
    x = table.column(name).combine_chunks()
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def _bytes(vector: str):
    return F.coalesce(F.size(vector), F.lit(0)).cast("long") * 8 + 64


def sizes(rows: DataFrame, vector: str, within: str) -> DataFrame:
    """(within, _row_bytes) of each group of rows."""
    return rows.groupBy(within).agg(F.sum(_bytes(vector)).alias("_row_bytes"))


def nearest(rows: DataFrame, queries: DataFrame, k: int, kind: str, id_col: str, vector: str = "embedding", largest: bool = True, within: str | None = None, row_sizes: DataFrame | None = None, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """The columns of the rows and the queries without the vectors, and score: at least the k best pairs of each query are there, some more where the rows take several cells.

    rows: id_col, vector and others; queries: query_id, query (a vector) and others. A missing or not finite score is 0, and so is that of vectors of different lengths. Equal scores: by id,
    the largest or the smallest first. within: a column of both; a query is compared with the rows of its own value. row_sizes: sizes(rows), if it is known.
    """
    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = lambda b: F.greatest(F.lit(1), F.ceil(b / F.lit(cell_bytes))).cast("int")
    if within is None:
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(_bytes(vector)), F.lit(0))).first()
        m, asked = queries.agg(F.count("*"), F.coalesce(F.sum(_bytes("query")), F.lit(0))).first()
        down, across = max(1, min(n, -(-size // cell_bytes))), max(1, min(m, -(-asked // cell_bytes)))
        down = max(down, min(n, 2 * tasks, n * m // across // CELL_PAIRS))
        left, right = rows.withColumns({"_down": F.lit(down), "_across": F.lit(across)}), queries.withColumns({"_down": F.lit(down), "_across": F.lit(across)})
        keys = ["_i", "_j"]
    else:
        grid = queries.groupBy(within).agg(F.sum(_bytes("query")).alias("_asked")).join(sizes(rows, vector, within) if row_sizes is None else row_sizes, within)
        grid = grid.select(within, parts(F.col("_row_bytes")).alias("_down"), parts(F.col("_asked")).alias("_across"))
        left, right = rows.join(grid, within), queries.join(grid, within)
        keys = [within, "_i", "_j"]
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.withColumn("_i", block(id_col, "_down")).withColumn("_j", every("_across")).drop("_down", "_across").repartition(tasks, *keys)
    right = right.withColumn("_j", block("query_id", "_across")).withColumn("_i", every("_down")).drop("_down", "_across").repartition(tasks, *keys)
    own, others = [c for c in rows.columns if c != vector], [c for c in queries.columns if c not in ("query", within)]
    schema = StructType([*(rows.schema[c] for c in own), *(queries.schema[c] for c in others), StructField("score", DoubleType())])

    def cell(near: pa.Table, asks: pa.Table) -> pa.Table:
        rank = pc.rank(near.column(id_col), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        i, j, score = best(_one(near, vector), _one(asks, "query"), rank if largest else -rank, k, kind)
        a, b = near.select(own).take(pa.array(i)), asks.select(others).take(pa.array(j))
        return pa.table([*a.columns, *b.columns, pa.array(score)], names=[*own, *others, "score"])

    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)
    return out.withColumn("score", F.round("score", PLACES))
