"""Nearest neighbours by largest inner product through vantage-point trees, one for each shard of the vectors.

Inner product becomes a metric by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm (queries get 0):
Euclidean distance then orders candidates as the inner product does.  A query goes down each shard's tree with
triangle-inequality pruning; ``factor`` above one prunes earlier and may lose neighbours, one is exact.  Shards hold
a bounded number of vectors, their number grows with the input, and queries meet shards in bounded blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

SHARD_ROWS, QUERY_ROWS, LEAF = 8192, 4096, 96


def finite_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v), a row for each row: only vectors that are neither null, empty nor zero and have finite components throughout."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(v.isNotNull() & ~bad & some & F.col("vec_id").isNotNull())


class Tree:
    """Vantage-point tree over rows of ``x``; ``order`` lists rows so that every node is a slice."""

    def __init__(self, x: np.ndarray, seed: int = 7) -> None:
        self.x, self.order, self.nodes = x, np.arange(len(x)), []
        rng = np.random.default_rng(seed)
        self._build(0, len(x), rng)

    def _build(self, lo: int, hi: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if hi - lo <= LEAF:
            self.nodes[me] = (lo, hi)
            return me
        rows = self.order[lo:hi]
        point = self.x[rows[rng.integers(len(rows))]]
        d = np.sqrt(((self.x[rows] - point) ** 2).sum(axis=1))
        by = np.argsort(d, kind="stable")
        self.order[lo:hi] = rows[by]
        mid = (hi - lo) // 2
        radius = float(d[by[mid]])
        inside = self._build(lo, lo + mid, rng)
        outside = self._build(lo + mid, hi, rng)
        self.nodes[me] = (point, radius, inside, outside)
        return me

    def search(self, q: np.ndarray, own: np.ndarray, rows_of: np.ndarray, ids: np.ndarray, k: int, factor: float, slack: float, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query the scores and indices (-1 for none) of its k best rows other than its own; own and rows_of number the rows.

        Rows are ordered by score, then by id.  Distances by matrix products only say which rows can be among the best;
        ``slack`` covers their rounding, which grows with the norms, and all rows within it are scored exactly, so that equal
        rows have equal scores.  ``limit`` is the square that all rows' lengths have been lifted to.

        All queries go down together, nearer side first for each; only those that a side may still serve go on.
        """
        n = len(q)
        best_s, best_i = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        worst, q2 = np.full(n, np.inf), (q**2).sum(axis=1)

        def visit(node: int, who: np.ndarray) -> None:
            if not len(who):
                return
            at = self.nodes[node]
            if len(at) == 2:
                rows = self.order[at[0] : at[1]]
                d = np.sqrt(np.maximum(q2[who][:, None] + (self.x[rows] ** 2).sum(axis=1) - 2 * q[who] @ self.x[rows].T, 0))
                may = (d <= worst[who][:, None] + slack) & (own[who][:, None] != rows_of[rows][None, :])
                some = may.any(axis=1)
                who, may = who[some], may[some]
                if not len(who):
                    return
                scores = np.full(may.shape, -np.inf)
                a, b = np.nonzero(may)
                scores[a, b] = _scores(q[who[a]], self.x[rows[b]])
                all_s = np.concatenate((best_s[who], scores), axis=1)
                all_i = np.concatenate((best_i[who], np.broadcast_to(rows, scores.shape)), axis=1)
                key = np.where(np.isinf(all_s), np.iinfo(np.int64).max, ids[all_i])
                pick = np.lexsort((key, -all_s), axis=1)[:, :k]
                best_s[who] = np.take_along_axis(all_s, pick, axis=1)
                best_i[who] = np.where(np.isinf(best_s[who]), -1, np.take_along_axis(all_i, pick, axis=1))
                worst[who] = np.sqrt(np.maximum(q2[who] + limit - 2 * best_s[who, -1], 0))
                return
            point, radius, inside, outside = at
            d = np.sqrt(((q[who] - point) ** 2).sum(axis=1))
            near = d < radius
            for first, second, mine in ((inside, outside, near), (outside, inside, ~near)):
                visit(first, who[mine])
                # a side is left out if it lies beyond the worst neighbour so far, sooner for factors above one
                gap = np.abs(d[mine] - radius) * factor
                visit(second, who[mine][gap <= worst[who[mine]] + slack])

        visit(0, np.arange(n))
        return best_s, best_i


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest by inner product, ties to the smaller vec_id.

    is_query is a condition on vec_id.  Vectors that are null, empty, zero, or hold null or non-finite components take
    no part; neither do rows without a vec_id.  Vectors of another length than the query's have no inner product with
    it and are no candidates.  Fewer candidates than k: all of them.  Rows that repeat a vec_id are rows of their own:
    each is a candidate for all but itself, and each that is a query is answered.  An empty table gives no rows; other
    columns are ignored.
    """
    clean = finite_vectors(vectors, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()).withColumn("width", F.size("v"))
    clean = stored(clean, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows, top = clean.agg(F.count("*"), F.max(norm)).first()
    queries = clean.where(is_query)
    n_queries = queries.count()
    shards, blocks = max(1, -(-rows // SHARD_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    limit = (top or 0.0) * (1 + 1e-12)
    slack = 1e-6 * (limit**0.5)
    number = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = clean.select("row", "vec_id", "v", "width", number(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("row", "vec_id", "v", "width", number(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def each(base: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(base) or not len(ask):
            return empty
        base, ask = base.sort_values(["vec_id", "row"]), ask.sort_values(["vec_id", "row"])
        ids, own = base["vec_id"].to_numpy(), ask["row"].to_numpy()
        x, q = np.array(base["v"].tolist(), np.float64), np.array(ask["v"].tolist(), np.float64)
        lift = np.sqrt(np.maximum(limit - (x**2).sum(axis=1), 0))
        tree = Tree(np.column_stack((x, lift)))
        scores, found = tree.search(np.column_stack((q, np.zeros(len(q)))), own, base["row"].to_numpy(), ids, k, factor, slack, limit)
        who, place = np.nonzero(found >= 0)
        return pd.DataFrame({"query_row": own[who], "query_id": ask["vec_id"].to_numpy()[who], "vec_id": ids[found[who, place]], "score": scores[who, place]})

    on = ["width", "shard", "block"]
    got = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(each, "query_row long, query_id long, vec_id long, score double")
    # the k best of each query over the shards: k rows a shard and query
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    top_k = got.groupBy("query_row", "query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("p", "x"))
    return top_k.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
