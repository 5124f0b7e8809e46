"""Training triplets: (anchor, positive, negative) from generated negatives
or from the labelled non-match pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from pairlane.functions.text import side_text
from pairlane.plans.indexing import dense_index


def hash60(*parts) -> F.Column:
    """A non-negative 60-bit integer from md5 of the parts (same value in
    DuckDB via the hex prefix)."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("bigint")


def triplets_from_negatives(pairs: DataFrame, negatives: DataFrame, ratio: int = 1,
                            seed: int = 42) -> DataFrame:
    """Each match row gets at most ``ratio`` of the negatives generated for
    its pair_id, chosen in seeded hash order of the negative text; match
    rows without negatives are dropped.

    The order does not depend on the match row, so the best ``ratio``
    negatives are picked once per pair_id (a ranked window that Spark
    pre-limits in every map partition) and only then joined to the match
    rows: a pair_id shared by many rows never expands to all pairs of its
    group, the output is bounded by ``ratio`` per match row."""
    m = pairs.filter(F.col("label") == 1).select(
        "pair_id", side_text("left").alias("anchor_text"), side_text("right").alias("positive_text"))
    w = W.partitionBy("pair_id").orderBy(
        F.md5(F.concat(F.lit(f"{seed}|"), F.col("negative_text"))), F.col("negative_text"))
    top = (negatives.select("pair_id", "negative_text")
           .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= ratio).drop("_r"))
    return m.join(top, "pair_id").select("pair_id", "anchor_text", "positive_text", "negative_text")


def triplets_to_negatives(triplets: DataFrame) -> DataFrame:
    return triplets.select("pair_id", "negative_text")


def contrastive_triplets(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """One negative right side per match from the global pool: the hard pool
    if it has any row, else the soft pool (NULL flag counts as soft).  The
    pool is numbered 0..m-1 in seeded hash order and each match picks
    ``hash(seed, pair_id) mod m`` — an equi join, never a cross join."""
    nm = pairs.filter(F.col("label") == 0).select(
        "pair_id", F.coalesce(F.col("is_hard_negative"), F.lit(False)).alias("hard"),
        side_text("right").alias("negative_text"))
    n_hard = nm.filter("hard").limit(1).count()
    pool = nm.filter(F.col("hard") if n_hard else ~F.col("hard"))
    pool = pool.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|pool|"), "pair_id")))
    pool = dense_index(pool, ["_h", "pair_id"], "pool_idx")
    m_size = pool.count()
    m = pairs.filter(F.col("label") == 1).select(
        "pair_id", side_text("left").alias("anchor_text"), side_text("right").alias("positive_text"))
    m = m.withColumn("pool_idx", F.pmod(hash60(F.lit(f"{seed}|pick|"), F.col("pair_id")), F.lit(m_size)))
    return (m.join(pool.select("pool_idx", "negative_text"), "pool_idx")
            .select("pair_id", "anchor_text", "positive_text", "negative_text"))


def contrastive_triplets_anchor(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """Negative from the same left offer: hard first, then seeded hash.
    ``min`` over a struct is a partial aggregate, so a left offer with a
    huge number of non-matches is still combined map-side."""
    nm = pairs.filter(F.col("label") == 0).select(
        "id_left", F.struct(
            F.when(F.col("is_hard_negative") == True, 0).otherwise(1).alias("k"),  # noqa: E712
            F.md5(F.concat(F.lit(f"{seed}|"), "pair_id")).alias("h"),
            side_text("right").alias("negative_text")).alias("c"))
    best = nm.groupBy("id_left").agg(F.min("c").alias("c"))
    m = pairs.filter(F.col("label") == 1).select(
        "pair_id", "id_left", side_text("left").alias("anchor_text"),
        side_text("right").alias("positive_text"))
    return m.join(best, "id_left").select("pair_id", "anchor_text", "positive_text",
                                          F.col("c.negative_text").alias("negative_text"))
