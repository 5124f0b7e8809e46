"""Ranks of the positive, top-k candidates and retrieval metrics.

``positive_rank`` never sorts: the 1-indexed position of the positive in
(score desc, corpus_idx asc) order is ``1 + #(score > s+) + #(score = s+ and
idx < idx+)``.  Score tables may be sparse (pairs with no shared term are
absent, i.e. score 0); absent documents are added back by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

SCORE_DIGITS = 9     # scores are rounded before comparing (engine-neutral ties)
METRIC_DIGITS = 6


def positive_scores(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """(query_id, pos_idx, s_pos): score of the positive, 0 when absent."""
    hit = scores.join(positives.withColumnRenamed("pos_idx", "corpus_idx"),
                      ["query_id", "corpus_idx"]).select("query_id", F.col("score").alias("_s"))
    return (positives.join(hit, "query_id", "left")
            .select("query_id", "pos_idx", F.coalesce("_s", F.lit(0.0)).alias("s_pos")))


def positive_rank(scores: DataFrame, positives: DataFrame) -> DataFrame:
    """scores(query_id, corpus_idx, score) sparse; positives(query_id, pos_idx)
    -> ranks(query_id, rank)."""
    sp = positive_scores(scores, positives)
    s = scores.repartition("query_id")
    agg = (s.join(sp, "query_id")
           .groupBy("query_id")
           .agg(F.count_if(F.col("score") > F.col("s_pos")).alias("n_gt"),
                F.count_if((F.col("score") == F.col("s_pos")) &
                           (F.col("corpus_idx") < F.col("pos_idx"))).alias("n_tie"),
                F.count_if(F.col("corpus_idx") < F.col("pos_idx")).alias("n_before")))
    r = sp.join(agg, "query_id", "left").fillna(0, ["n_gt", "n_tie", "n_before"])
    zero_fix = F.when(F.col("s_pos") == 0, F.col("pos_idx") - F.col("n_before")).otherwise(0)
    return r.select("query_id", (1 + F.col("n_gt") + F.col("n_tie") + zero_fix).cast("bigint").alias("rank"))


def topk(scores: DataFrame, k: int, part: str = "query_id", order_idx: str = "corpus_idx") -> DataFrame:
    """Best k rows per query by (score desc, idx asc); Spark plans a
    per-partition WindowGroupLimit before the shuffle."""
    w = W.partitionBy(part).orderBy(F.col("score").desc(), F.col(order_idx).asc())
    return (scores.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def acc_at_k(ranks: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return ranks.agg(F.round(F.sum(F.when(F.col("rank") <= k, w).otherwise(0)) /
                             F.sum(w), METRIC_DIGITS).alias(f"acc_at_{k}"))


def mrr(ranks: DataFrame, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return ranks.agg(F.round(F.sum(w / F.col("rank")) / F.sum(w), METRIC_DIGITS).alias("mrr"))


def retrieval_metrics(ranks: DataFrame, ks=(1, 5), weight: str | None = None, by: str | None = None) -> DataFrame:
    """One row (one for each value of ``by``): mrr, acc_at_k..., n_queries (DOUBLE).
    No queries -> no row."""
    w = F.col(weight) if weight else F.lit(1)
    aggs = [F.round(F.sum(w / F.col("rank")) / F.sum(w), METRIC_DIGITS).alias("mrr")]
    aggs += [F.round(F.sum(F.when(F.col("rank") <= k, w).otherwise(0)) / F.sum(w),
                     METRIC_DIGITS).alias(f"acc_at_{k}") for k in ks]
    aggs.append(F.sum(w).cast("double").alias("n_queries"))
    return ranks.groupBy(*([by] if by else [])).agg(*aggs).filter(F.col("n_queries") > 0)
