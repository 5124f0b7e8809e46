"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates lie in blocks; a block holds one list per dimension, sorted by that
component.  A query walks the lists of its own dimensions from their best end
(the low end where its component is negative), scores what it meets, and stops
once the score of anything unmet, bounded by the components at the depths
reached, cannot beat its k-th result.  Blocks return k rows a query at most and
a window keeps the best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from pairlane.llm.common import small_batches, stored

BLOCK_ROWS, QUERY_ROWS = 8192, 1024
FIRST_DEPTH = 8

FOUND = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and ``x``: floor(scale * component).  Vectors that are null, empty
    or hold a null or non-finite component, and rows without an id, drop out."""
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").where(ok)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x")))


class SortedLists:
    """The per-dimension lists of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.up = np.argsort(x, axis=0, kind="stable").T  # one list per dimension, ascending
        self.largest = float(np.abs(x.astype(np.float64)).max()) if x.size else 0.0
        self.as_float = x.astype(np.float64)

    def top(self, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, vec_id), ties to the smaller id, without ``own``."""
        n, dims = self.x.shape
        exact = self.largest * float(np.abs(q.astype(np.float64)).max(initial=0)) * dims < 2.0 ** 53
        x, weights = (self.as_float, q.astype(np.float64)) if exact else (self.x, q)
        used = np.flatnonzero(q)
        rising = (q[used] > 0)[:, None]

        def lists(a, z):
            """Places a to z of the lists of the used dimensions, best first."""
            return np.where(rising, self.up[used, n - z:n - a][:, ::-1], self.up[used, a:z])

        met, depth, best = np.zeros(n, bool), 0, []
        step = FIRST_DEPTH
        while depth < n and not met.all():  # with all met there is nothing left to bound
            deeper = min(n, depth + step) if len(used) else n
            fresh = np.zeros(n, bool)
            if len(used):
                fresh[lists(depth, deeper).ravel()] = True
            else:
                fresh[:] = True  # a query of zeros scores everyone 0
            fresh &= ~met
            met |= fresh
            depth, step = deeper, step * 2
            new = np.flatnonzero(fresh)
            if len(new):
                # many at once: the whole block is one product, cheaper than gathering rows
                score = (x @ weights)[new] if 4 * len(new) > n else x[new] @ weights
                if len(new) > 4 * k + 8:  # only what may enter: ties of the k-th stay
                    least = np.partition(score, len(new) - k - 1)[len(new) - k - 1]
                    new, score = new[score >= least], score[score >= least]
                best += [(int(s), int(i)) for s, i in zip(score, self.ids[new]) if i != own]
                best = sorted(set(best), key=lambda r: (-r[0], r[1]))[:k]
            if len(best) == k and depth < n:
                bound = (x[lists(depth - 1, depth)[:, 0], used] * weights[used]).sum() if len(used) else 0
                if best[-1][0] > bound:
                    break
        return best


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k candidates with the
    highest inner product for each query (``vec_id``, ``x`` on both sides), ties
    to the smaller vec_id, never the query's own id.  Vectors meet only vectors
    of their own length.  Repeated rows count once."""
    spark = candidates.sparkSession
    small_batches(spark, 2048)
    candidates, queries = stored(candidates, "vectors"), stored(queries, "queries")
    blocks = max(1, -(-candidates.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // QUERY_ROWS))
    place = F.xxhash64("vec_id")
    left = candidates.select("vec_id", "x", F.size("x").alias("dims"), F.pmod(place, F.lit(blocks)).alias("b"),
                             F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))
    right = queries.select("vec_id", "x", F.size("x").alias("dims"), F.pmod(place, F.lit(query_blocks)).cast("int").alias("q"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))

    def tile(cands: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(cands) and len(qs):
            lists = SortedLists(cands["vec_id"].to_numpy(), np.stack(cands["x"].to_numpy()).astype(np.int64))
            for q, x in zip(qs["vec_id"], qs["x"]):
                rows += [(q, i, s) for s, i in lists.top(np.asarray(x, dtype=np.int64), q, k)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    key = ["b", "q", "dims"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile, FOUND).distinct()
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
