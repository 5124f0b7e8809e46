"""TF-IDF retrieval: word 1-2-grams, lowercase, accent fold, sublinear tf,
smooth idf, L2-normalised rows, cosine scores, vocabulary cap.

Library-default semantics reproduced: tokens are runs of >= 2 word
characters; idf = ln((1 + N) / (1 + df)) + 1; tf' = 1 + ln(tf); the
vocabulary cap keeps the ``max_features`` terms with the highest total
count in the corpus (ties by term).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from pairlane.functions.text import char_wb_ngrams, word_ngrams, word_tokens
from pairlane.plans.blocked import blocked_sparse_scores
from pairlane.plans.indexing import dense_index
from pairlane.plans.maxscore import bounded_topk
from pairlane.session import reuse


@dataclass
class TfidfParams:
    max_n: int = 2
    analyzer: str = "word"          # or "char_wb"
    min_n: int = 1
    max_features: int | None = 50_000
    sublinear_tf: bool = True
    strip_accents: str | None = "jvm"   # or None


def with_terms(df: DataFrame, id_col: str, p: TfidfParams, text_col: str = "text") -> DataFrame:
    """(id, term) rows.  Tokens are projected into their own column before
    the n-gram lambda reads them: a lambda that references the token
    *expression* would re-run the regex for every element."""
    if p.analyzer == "char_wb":
        return df.select(id_col, F.explode(char_wb_ngrams(F.col(text_col), p.min_n, p.max_n,
                                                          p.strip_accents)).alias("term"))
    toks = df.select(id_col, word_tokens(F.col(text_col), p.strip_accents).alias("_tok"))
    return toks.select(id_col, F.explode(word_ngrams(F.col("_tok"), p.max_n)).alias("term"))


def term_counts(docs: DataFrame, id_col: str, p: TfidfParams, partitions: int | None = None) -> DataFrame:
    """(id, term, tf).  Docs are hash-partitioned by id first so the
    (id, term) aggregate and the later per-document norm need no further
    shuffle."""
    d = docs.select(id_col, "text")
    d = d.repartition(partitions, id_col) if partitions else d.repartition(id_col)
    return (with_terms(d, id_col, p)
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def term_stats(tf: DataFrame) -> DataFrame:
    """Per term: total count in the corpus and document frequency."""
    return tf.groupBy("term").agg(F.sum("tf").alias("cnt"), F.count(F.lit(1)).alias("df"))


def vocab_cap(stats: DataFrame, max_features: int | None) -> DataFrame:
    """Keep the ``max_features`` most frequent terms (TakeOrderedAndProject,
    bounded by the cap) and number them."""
    if max_features is None:
        return dense_index(stats, [F.col("term")], "term_id")
    top = stats.orderBy(F.col("cnt").desc(), F.col("term").asc()).limit(max_features)
    # The cap bounds this table, so a single ordered window is cheap here.
    return top.withColumn("term_id", F.row_number().over(W.orderBy("term")) - 1)


@dataclass
class TfidfModel:
    vocab: DataFrame        # term, term_id, df, idf (bounded by max_features)
    doc_vectors: DataFrame  # corpus_idx, term_id, w (L2-normalised)
    n_docs: int
    params: TfidfParams


#: A vocabulary is broadcast up to this cap (some tens of MB), beyond it joined.
BROADCAST_TERMS = 200_000


def _weights(tf: DataFrame, vocab: DataFrame, id_col: str, p: TfidfParams) -> DataFrame:
    bounded = p.max_features is not None and p.max_features <= BROADCAST_TERMS
    v = F.broadcast(vocab) if bounded else vocab
    t = tf.join(v.select("term", "term_id", "idf"), "term")
    tfw = (1 + F.log(F.col("tf"))) if p.sublinear_tf else F.col("tf").cast("double")
    t = t.withColumn("w0", tfw * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w0") * F.col("w0")).over(W.partitionBy(id_col)))
    return t.select(id_col, "term_id", (F.col("w0") / norm).alias("w"))


def tfidf_fit(corpus: DataFrame, p: TfidfParams = TfidfParams(), n_docs: int | None = None,
              checkpoint: bool = True) -> TfidfModel:
    """corpus(corpus_idx, text) -> vocabulary with idf + document vectors."""
    tf = term_counts(corpus, "corpus_idx", p)
    if checkpoint:
        tf = reuse(tf)
    n = n_docs if n_docs is not None else corpus.count()
    vocab = vocab_cap(term_stats(tf), p.max_features)
    vocab = vocab.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    if checkpoint:
        vocab = reuse(vocab)
    docs = _weights(tf, vocab, "corpus_idx", p)
    if checkpoint:
        docs = reuse(docs)
    return TfidfModel(vocab, docs, n, p)


def tfidf_vectors(model: TfidfModel, docs: DataFrame, id_col: str) -> DataFrame:
    """Vectors for new texts; out-of-vocabulary terms are dropped."""
    tf = term_counts(docs, id_col, model.params)
    return _weights(tf, model.vocab, id_col, model.params)


def sparse_scores(qv: DataFrame, dv: DataFrame) -> DataFrame:
    """Sparse matrix product by tiles; rounded cosine of pairs that share a term."""
    return blocked_sparse_scores(qv, dv)


def tfidf_scores(model: TfidfModel, qv: DataFrame) -> DataFrame:
    return sparse_scores(qv, model.doc_vectors)


def tfidf_topk(model: TfidfModel, qv: DataFrame, query_ids: DataFrame, k: int) -> DataFrame:
    """The k best documents of every query of ``query_ids``."""
    return bounded_topk(qv, model.doc_vectors, query_ids, k, query_ids.count(), model.n_docs)


def known_matches(pairs: DataFrame, es) -> DataFrame:
    """(query_id, corpus_idx) for every right text labelled a match of the
    query's left text — these are never hard negatives."""
    from pairlane.functions.text import side_text
    m = (pairs.filter(F.col("label") == 1)
         .select(side_text("left").alias("query_text"), side_text("right").alias("text"))
         .distinct())
    c = es.corpus.select("text", "corpus_idx")
    q = es.queries.select("query_id", "query_text")
    return m.join(c, "text").join(q, "query_text").select("query_id", "corpus_idx").distinct()


def mine_hard_negatives(pairs: DataFrame, es, qv: DataFrame, dv: DataFrame, k: int) -> DataFrame:
    """Per match query: the k most similar corpus items that are neither its
    positive nor any labelled match of the same left text.  Queries of one left
    text have one answer, so each left text is searched once."""
    same = es.queries.select("query_id", "query_text")
    asked = same.groupBy("query_text").agg(F.min("query_id").alias("rep"))
    of_query = reuse(same.join(asked, "query_text").select("query_id", "rep"))
    reps = of_query.select(F.col("rep").alias("query_id")).distinct()
    # every query's positive is a labelled match of its left text
    gone = known_matches(pairs, es).join(reps, "query_id", "left_semi")
    found = bounded_topk(qv.join(reps, "query_id", "left_semi"), dv, reps, k, reps.count(), es.n_corpus, gone)
    return (of_query.join(found.withColumnRenamed("query_id", "rep"), "rep")
            .select("query_id", "corpus_idx", "score", "rank"))
