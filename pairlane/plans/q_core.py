"""Registered queries: pair text, filters, corpus building, ranks, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.functions.text import negative_cache_key, side_text
from pairlane.operators import corpus as C
from pairlane.operators import ranking as R
from pairlane.plans import sqltext as S
from pairlane.plans.common import pairs, with_pairs
from pairlane.plans.evaluate import tfidf_ranks
from pairlane.plans.registry import query
from pairlane.schema import UNIFIED_COLS

LT, RT = S.side_text("left"), S.side_text("right")


@query("product_text", with_pairs(f"SELECT pair_id, {LT} AS text_left, {RT} AS text_right FROM pairs"))
def _product_text(spark, sf):
    return pairs(spark, sf).select("pair_id", side_text("left").alias("text_left"),
                                   side_text("right").alias("text_right"))


@query("product_text_priced", with_pairs(
    f"SELECT pair_id, {S.side_text('left', True)} AS text_left, "
    f"{S.side_text('right', True)} AS text_right FROM pairs"))
def _product_text_priced(spark, sf):
    return pairs(spark, sf).select("pair_id", side_text("left", True).alias("text_left"),
                                   side_text("right", True).alias("text_right"))


_QCOLS = ", ".join(f'"{c}"' for c in UNIFIED_COLS)


@query("match_filter", with_pairs(f"SELECT {_QCOLS} FROM pairs WHERE label = 1"))
def _match_filter(spark, sf):
    return C.match_filter(pairs(spark, sf))


@query("pairwise_view", with_pairs(
    f"SELECT {LT} AS text_left, {RT} AS text_right, label, pair_id FROM pairs"))
def _pairwise_view(spark, sf):
    return pairs(spark, sf).select(side_text("left").alias("text_left"),
                                   side_text("right").alias("text_right"), "label", "pair_id")


@query("training_pairs", with_pairs(
    f"SELECT pair_id, {LT} AS anchor, {RT} AS positive FROM pairs WHERE label = 1"))
def _training_pairs(spark, sf):
    return (C.match_filter(pairs(spark, sf))
            .select("pair_id", side_text("left").alias("anchor"), side_text("right").alias("positive")))


@query("negative_cache_key", with_pairs(
    f"SELECT pair_id, {LT} AS product_text, "
    f"sha256(lower({S.strip(LT)}) || '||n=' || 5) AS cache_key FROM pairs WHERE label = 1"))
def _negative_cache_key(spark, sf):
    m = C.match_filter(pairs(spark, sf)).select("pair_id", side_text("left").alias("product_text"))
    return m.withColumn("cache_key", negative_cache_key("product_text", 5))


_CORPUS_SQL = f"""
corpus_raw AS (SELECT {RT} AS text, min(pair_id) AS first_pair_id, count(*) AS n_rows FROM pairs GROUP BY 1),
corpus AS (SELECT row_number() OVER (ORDER BY first_pair_id, text) - 1 AS corpus_idx, text, first_pair_id, n_rows
           FROM corpus_raw)"""


@query("dedupe_corpus", with_pairs("SELECT * FROM corpus", _CORPUS_SQL))
def _dedupe_corpus(spark, sf):
    return C.dedupe_corpus(pairs(spark, sf)).select("corpus_idx", "text", "first_pair_id", "n_rows")


_EVAL_SQL = _CORPUS_SQL + f""",
q_raw AS (SELECT {LT} AS query_text, {RT} AS positive_text, count(*) AS n_rows, min(pair_id) AS first_pair_id
          FROM pairs WHERE label = 1 GROUP BY 1, 2),
queries AS (SELECT row_number() OVER (ORDER BY q.first_pair_id, q.query_text, q.positive_text) - 1 AS query_id,
            q.query_text, q.positive_text, q.n_rows, q.first_pair_id, c.corpus_idx AS pos_idx
            FROM q_raw q JOIN corpus c ON c.text = q.positive_text)"""


@query("eval_corpus", with_pairs("SELECT * FROM queries", _EVAL_SQL))
def _eval_corpus(spark, sf):
    return C.eval_corpus(pairs(spark, sf)).queries


@query("positives_lookup", with_pairs(f"""
SELECT m.pair_id, c.corpus_idx AS pos_idx
FROM (SELECT pair_id, {RT} AS positive_text FROM pairs WHERE label = 1) m
JOIN corpus c ON c.text = m.positive_text""", _CORPUS_SQL))
def _positives_lookup(spark, sf):
    p = pairs(spark, sf)
    corpus = C.dedupe_corpus(p)
    m = C.match_filter(p).select("pair_id", side_text("right").alias("positive_text"))
    found, _ = C.positives_lookup(m, corpus)
    return found.select("pair_id", "pos_idx")


_RANKS_SQL = S.tfidf_ctes()


@query("positive_rank", with_pairs("SELECT query_id, rank FROM ranks", _RANKS_SQL))
def _positive_rank(spark, sf):
    return tfidf_ranks(pairs(spark, sf))[3].select("query_id", "rank")


@query("acc_at_k", with_pairs(
    "SELECT " + ", ".join(f"round(sum(CASE WHEN rank <= {k} THEN n_rows ELSE 0 END) / sum(n_rows), 6) AS acc_at_{k}"
                          for k in (1, 5, 10)) + " FROM ranks", _RANKS_SQL))
def _acc_at_k(spark, sf):
    r = tfidf_ranks(pairs(spark, sf))[3]
    return r.agg(*[F.round(F.sum(F.when(F.col("rank") <= k, F.col("n_rows")).otherwise(0)) /
                           F.sum("n_rows"), R.METRIC_DIGITS).alias(f"acc_at_{k}") for k in (1, 5, 10)])


@query("mrr", with_pairs("SELECT round(sum(n_rows / rank) / sum(n_rows), 6) AS mrr FROM ranks", _RANKS_SQL))
def _mrr(spark, sf):
    return R.mrr(tfidf_ranks(pairs(spark, sf))[3], weight="n_rows")


@query("topk_corpus", with_pairs(S.topk_select(10), _RANKS_SQL))
def _topk_corpus(spark, sf):
    """The ten best corpus items of every query."""
    from pairlane.operators import tfidf as T
    es = C.eval_corpus(pairs(spark, sf))
    m = T.tfidf_fit(es.corpus.select("corpus_idx", "text"), n_docs=es.n_corpus)
    qv = T.tfidf_vectors(m, es.queries.select("query_id", F.col("query_text").alias("text")), "query_id")
    return T.tfidf_topk(m, qv, es.queries.select("query_id"), 10)
