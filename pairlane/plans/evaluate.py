"""End-to-end retrieval evaluation plans (corpus -> fit -> score -> rank ->
metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlane.operators.corpus import EvalSet, eval_corpus
from pairlane.operators.ranking import retrieval_metrics
from pairlane.operators.tfidf import TfidfParams, tfidf_fit, tfidf_vectors
from pairlane.plans.maxscore import bounded_rank


def tfidf_ranks(pairs: DataFrame, params: TfidfParams = TfidfParams(),
                es: EvalSet | None = None):
    es = es or eval_corpus(pairs)
    model = tfidf_fit(es.corpus.select("corpus_idx", "text"), params, n_docs=es.n_corpus)
    qv = tfidf_vectors(model, es.queries.select("query_id", F.col("query_text").alias("text")), "query_id")
    n_q = es.queries.count()
    ranks = bounded_rank(qv, model.doc_vectors, es.positives, n_q)
    return es, model, qv, ranks.join(es.queries.select("query_id", "n_rows"), "query_id")


def tfidf_evaluate(pairs: DataFrame, params: TfidfParams = TfidfParams(),
                   ks=(1, 5)) -> DataFrame:
    """One metrics row: mrr, acc_at_1, acc_at_5, n_queries."""
    _, _, _, ranks = tfidf_ranks(pairs, params)
    return retrieval_metrics(ranks, ks, weight="n_rows")
