"""Inputs derived from the driver tables (see FIXTURES.md §3).

``pairs`` turns ``part`` into a labelled offer-pair table in the unified
schema: left = the part, right = the same part with swapped title words (a
match) or six other parts (non-matches).  Built with ``explode(sequence)``
instead of a cross join; the row count of ``part`` is a scalar subquery.

Spark takes the size of a scan from its compressed file, here a small part of what
the rows need in memory, so joins with rows of ``part`` ask for a merge join: a
broadcast would send all of them through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.schema import UNIFIED_COLS
from pairlane.sources.tables import table

N_RIGHTS = 7  # 1 match + 6 non-matches per left part


_PAIRS: dict = {}


def pairs(spark: SparkSession, sf_dir: str, full_schema: bool = True,
          materialized: bool = True) -> DataFrame:
    """The derived pair table.  By default it is built once per session and
    data folder and kept (memory, spilling to disk), so every plan reads a
    table instead of re-running the joins that derive it."""
    key = (spark.sparkContext.applicationId, sf_dir, full_schema)
    if materialized and key in _PAIRS:
        return _PAIRS[key]
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand",
                 "p_type", "p_size", "p_retailprice")
    n = F.lit(part.count())  # one scalar, computed once
    l = part.select(F.col("p_partkey").alias("lk"), F.col("p_name").alias("l_name"),
                    F.col("p_brand").alias("l_brand"), F.col("p_type").alias("l_type"),
                    F.col("p_size").alias("l_size"),
                    F.col("p_retailprice").alias("l_price"))
    r = part.select(F.col("p_partkey").alias("rk"), F.col("p_name").alias("r_name"),
                    F.col("p_brand").alias("r_brand"), F.col("p_type").alias("r_type"),
                    F.col("p_size").alias("r_size"),
                    F.col("p_retailprice").alias("r_price"))
    # a key that is there twice meets both of its rows
    keys = (part.select(F.col("p_partkey").alias("lk")).join(l.hint("merge"), "lk")
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(N_RIGHTS - 1)))))
    keys = keys.withColumn(
        "rk", F.when(F.col("j") == 0, F.col("lk"))
        .otherwise((F.col("lk") * 7 + F.col("j") * 13 + 1) % n)
    ).filter(~((F.col("j") > 0) & (F.col("rk") == F.col("lk"))))
    j = keys.join(r.hint("merge"), "rk")
    out = j.select(
        F.concat(F.lit("L"), F.col("lk")).alias("id_left"),
        F.concat_ws(" ", "l_name", F.col("l_size").cast("string")).alias("title_left"),
        F.col("l_type").alias("description_left"),
        F.col("l_brand").alias("brand_left"),
        F.col("l_price").cast("string").alias("price_left"),
        F.lit(None).cast("string").alias("priceCurrency_left"),
        F.concat(F.lit("R"), F.col("rk")).alias("id_right"),
        F.concat_ws(" ", F.split_part("r_name", F.lit(" "), F.lit(2)),
                    F.split_part("r_name", F.lit(" "), F.lit(1)),
                    F.col("r_size").cast("string")).alias("title_right"),
        F.when(F.col("rk") % 7 == 0, F.lit("")).otherwise(F.col("r_type")).alias("description_right"),
        F.when(F.col("rk") % 5 == 0, F.lit(None)).otherwise(F.col("r_brand")).alias("brand_right"),
        F.col("r_price").cast("string").alias("price_right"),
        F.lit(None).cast("string").alias("priceCurrency_right"),
        F.when(F.col("j") == 0, 1).otherwise(0).cast("int").alias("label"),
        F.concat(F.lit("L"), F.col("lk"), F.lit("#R"), F.col("rk")).alias("pair_id"),
        F.lit(None).cast("bigint").alias("cluster_id_left"),
        F.lit(None).cast("bigint").alias("cluster_id_right"),
        ((F.col("j") > 0) & (F.col("l_brand") == F.col("r_brand"))).alias("is_hard_negative"),
    )
    out = out.select(*UNIFIED_COLS) if full_schema else out
    if materialized:
        from pairlane.session import reuse
        out = reuse(out)
        _PAIRS[key] = out
    return out


# DuckDB form of the same table, used as a CTE by every oracle.  Price uses
# the same string form as Spark's cast(double as string).
PAIRS_SQL = """
pairs AS (
 WITH n AS (SELECT count(*) AS n FROM part),
 k AS (SELECT l.p_partkey AS lk, j.j,
        CASE WHEN j.j = 0 THEN l.p_partkey ELSE (l.p_partkey * 7 + j.j * 13 + 1) % n.n END AS rk
       FROM part l, (SELECT unnest(generate_series(0, 6)) AS j) j, n)
 SELECT concat('L', k.lk) AS id_left,
  concat(l.p_name, ' ', l.p_size) AS title_left,
  l.p_type AS description_left,
  l.p_brand AS brand_left,
  CAST(l.p_retailprice AS VARCHAR) AS price_left,
  CAST(NULL AS VARCHAR) AS "priceCurrency_left",
  concat('R', k.rk) AS id_right,
  concat(split_part(r.p_name, ' ', 2), ' ', split_part(r.p_name, ' ', 1), ' ', r.p_size) AS title_right,
  CASE WHEN k.rk % 7 = 0 THEN '' ELSE r.p_type END AS description_right,
  CASE WHEN k.rk % 5 = 0 THEN NULL ELSE r.p_brand END AS brand_right,
  CAST(r.p_retailprice AS VARCHAR) AS price_right,
  CAST(NULL AS VARCHAR) AS "priceCurrency_right",
  CAST(CASE WHEN k.j = 0 THEN 1 ELSE 0 END AS INTEGER) AS label,
  concat('L', k.lk, '#', 'R', k.rk) AS pair_id,
  CAST(NULL AS BIGINT) AS cluster_id_left,
  CAST(NULL AS BIGINT) AS cluster_id_right,
  (k.j > 0 AND l.p_brand = r.p_brand) AS is_hard_negative
 FROM k JOIN part l ON l.p_partkey = k.lk JOIN part r ON r.p_partkey = k.rk
 WHERE NOT (k.j > 0 AND k.rk = k.lk)
)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven kinds of model answers per part (FIXTURES.md §3)."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name")
    k = F.col("p_partkey") % 7
    nm = F.col("p_name")
    nl = F.lit("\n")
    resp = (F.when(k == 0, F.concat(F.lit('{"hard_negatives": ["'), nm, F.lit(' A", " '), nm, F.lit(' B "]}')))
            .when(k == 1, F.concat(F.lit("```json"), nl, F.lit('{"hard_negatives": ["'), nm, F.lit(' C"]}'), nl, F.lit("```")))
            .when(k == 2, F.concat(F.lit('{"reasoning": "r", "hard_negatives": ["'), nm, F.lit(' D", 7, "", null]}')))
            .when(k == 3, F.lit('{"hard_negatives": []}'))
            .when(k == 4, F.lit('{"hard_negatives": ["  ", ""]}'))
            .when(k == 5, F.concat(F.lit('{"hard_negatives": ["'), nm))
            .otherwise(F.lit("[1, 2]")))
    return part.select(
        F.concat(F.lit("L"), F.col("p_partkey")).alias("pair_id"),
        k.alias("kind"), resp.alias("response"),
        (F.lit(300) + F.col("p_partkey") % 50).alias("prompt_tokens"),
        (F.lit(100) + F.col("p_partkey") % 90).alias("completion_tokens"))


RESPONSES_SQL = """
responses AS (
 SELECT concat('L', p_partkey) AS pair_id, p_partkey % 7 AS kind,
 CASE p_partkey % 7
  WHEN 0 THEN concat('{"hard_negatives": ["', p_name, ' A", " ', p_name, ' B "]}')
  WHEN 1 THEN concat('```json', chr(10), '{"hard_negatives": ["', p_name, ' C"]}', chr(10), '```')
  WHEN 2 THEN concat('{"reasoning": "r", "hard_negatives": ["', p_name, ' D", 7, "", null]}')
  WHEN 3 THEN '{"hard_negatives": []}'
  WHEN 4 THEN '{"hard_negatives": ["  ", ""]}'
  WHEN 5 THEN concat('{"hard_negatives": ["', p_name)
  ELSE '[1, 2]' END AS response,
 300 + p_partkey % 50 AS prompt_tokens, 100 + p_partkey % 90 AS completion_tokens
 FROM part
)"""


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense retrieval fixture: within a label, odd-numbered vectors are
    queries and the next vector is their positive."""
    from pyspark.sql import Window as W
    e = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    r = e.withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy("vec_id")))
    q = r.filter(F.col("rn") % 2 == 1).select(
        F.col("vec_id").alias("query_id"), "label", "rn", F.col("embedding").alias("query_vec"))
    c = r.select(F.col("vec_id").alias("corpus_id"), "label",
                 (F.col("rn") - 1).alias("rn"), F.col("embedding").alias("corpus_vec"))
    return q.join(c, ["label", "rn"]).select("query_id", "corpus_id", "query_vec", "corpus_vec")


VECTOR_PAIRS_SQL = """
vector_pairs AS (
 WITH r AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)
 SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, q.embedding AS query_vec, c.embedding AS corpus_vec
 FROM r q JOIN r c ON q.label = c.label AND q.rn % 2 = 1 AND c.rn = q.rn + 1
)"""
