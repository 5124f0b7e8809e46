"""Evaluation corpus: de-duplicated right-side texts, match queries and
their positive's corpus index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlane.functions.text import side_text
from pairlane.plans.indexing import dense_index
from pairlane.session import materialize


def match_filter(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("label") == 1)


def dedupe_corpus(pairs: DataFrame, index: bool = True) -> DataFrame:
    """Unique right texts over all rows (both labels).  Order = first
    ``pair_id`` (string order) then text; ``corpus_idx`` is the dense
    position in that order.  Partial aggregation collapses hot texts before
    the shuffle."""
    c = (pairs.select(side_text("right").alias("text"), "pair_id")
         .groupBy("text")
         .agg(F.min("pair_id").alias("first_pair_id"),
              F.count(F.lit(1)).alias("n_rows")))
    if not index:
        return c
    return dense_index(c, ["first_pair_id", "text"], "corpus_idx")


@dataclass
class EvalSet:
    corpus: DataFrame      # corpus_idx, text, first_pair_id, n_rows
    queries: DataFrame     # query_id, query_text, positive_text, n_rows, first_pair_id
    positives: DataFrame   # query_id, pos_idx
    n_corpus: int
    dropped: DataFrame     # queries whose positive text is not in the corpus

    @property
    def n_dropped(self) -> int:
        return self.dropped.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]


def match_queries(pairs: DataFrame) -> DataFrame:
    """Left text of every match row.  Identical (query, positive) rows are
    folded into one query carrying its multiplicity ``n_rows`` so metrics
    stay row-weighted while the scoring work shrinks."""
    m = match_filter(pairs).select(side_text("left").alias("query_text"),
                                   side_text("right").alias("positive_text"), "pair_id")
    return (m.groupBy("query_text", "positive_text")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("pair_id").alias("first_pair_id")))


def positives_lookup(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equi-join positive text -> corpus index.  Returns (found, dropped)."""
    c = corpus.select(F.col("text").alias("positive_text"), F.col("corpus_idx").alias("pos_idx"))
    found = queries.join(c, "positive_text", "inner")
    dropped = queries.join(c, "positive_text", "left_anti")
    return found, dropped


def eval_corpus(pairs: DataFrame, checkpoint: bool = True) -> EvalSet:
    corpus = dedupe_corpus(pairs)  # checkpointed by dense_index
    q = match_queries(pairs)
    found, dropped = positives_lookup(q, corpus)
    found = dense_index(found, ["first_pair_id", "query_text", "positive_text"], "query_id",
                        checkpoint=checkpoint)
    queries = found.select("query_id", "query_text", "positive_text", "n_rows", "first_pair_id", "pos_idx")
    positives = found.select("query_id", "pos_idx")
    n_corpus = corpus.count()
    return EvalSet(corpus, queries, positives, n_corpus, dropped)
