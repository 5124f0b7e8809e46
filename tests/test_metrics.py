"""Ranks and metrics (cases follow the reference's metric tests), plus
sparse-table zero-overlap ranks and blocked-vs-sparse equality."""

import numpy as np
import pytest

from pairlane.operators import ranking as R


def _scores(spark, mat):
    rows = [(i, j, float(v)) for i, r in enumerate(mat) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "query_id long, corpus_idx long, score double")


def _pos(spark, pos):
    return spark.createDataFrame([(i, p) for i, p in enumerate(pos)], "query_id long, pos_idx long")


def _ranks(spark, mat, pos):
    r = R.positive_rank(_scores(spark, mat), _pos(spark, pos))
    return [x["rank"] for x in r.orderBy("query_id").collect()]


def test_best_positive(spark):
    m = np.random.default_rng(0).random((3, 5))
    pos = [int(np.argmax(r)) for r in m]
    assert _ranks(spark, m, pos) == [1, 1, 1]


def test_worst_positive(spark):
    assert _ranks(spark, [[0.9, 0.8, 0.7, 0.6, 0.1]], [4]) == [5]


def test_all_ties(spark):
    assert all(r >= 1 for r in _ranks(spark, np.ones((4, 4)), [0, 1, 2, 3]))


def test_identity(spark):
    r = R.positive_rank(_scores(spark, np.eye(4)), _pos(spark, [0, 1, 2, 3]))
    m = R.retrieval_metrics(r).first()
    assert m["mrr"] == 1.0 and m["acc_at_1"] == 1.0


def test_mixed(spark):
    s = np.zeros((3, 5))
    s[0, 2], s[0, 0], s[0, 1] = 5, 4, 3
    s[1, 0], s[1, 3], s[1, 1] = 5, 4, 3
    s[2, 1], s[2, 2], s[2, 0], s[2, 4] = 5, 4, 3, 2
    ranks = _ranks(spark, s, [2, 3, 3])
    assert ranks == [1, 2, 5]
    m = R.retrieval_metrics(R.positive_rank(_scores(spark, s), _pos(spark, [2, 3, 3])), (1, 5)).first()
    assert m["mrr"] == pytest.approx(1.7 / 3, abs=1e-6)
    assert m["acc_at_1"] == pytest.approx(1 / 3, abs=1e-6)
    assert m["acc_at_5"] == 1.0 and m["n_queries"] == 3


def test_zero_overlap_rows_absent(spark):
    """Sparse score tables omit zero scores; ranks must count them."""
    # corpus of 6; query 0 positive idx 4 has no score -> zero docs 0..3 with
    # idx < 4 tie before it, except doc 1 which scores 0.5 (counted as greater)
    sc = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.3), (1, 5, 0.9)],
                               "query_id long, corpus_idx long, score double")
    pos = spark.createDataFrame([(0, 4), (1, 2)], "query_id long, pos_idx long")
    r = {x["query_id"]: x["rank"] for x in R.positive_rank(sc, pos).collect()}
    dense0 = [0, 0.5, 0, 0, 0, 0]
    assert r[0] == 1 + 1 + 3 == 1 + sum(v > 0 for v in dense0) + 3
    assert r[1] == 2


def test_bounded_ranks_equal_score_table(spark):
    """Random sparse vectors with hot terms: ranks by bounds = ranks over the joined scores."""
    from pairlane.operators.tfidf import sparse_scores
    from pairlane.plans.maxscore import bounded_rank
    rng = np.random.default_rng(1)
    nq, nd, V = 60, 90, 40
    qv = [(q, int(t), float(rng.random())) for q in range(nq) for t in set(rng.integers(0, V, 6).tolist()) | {0}]
    dv = [(d, int(t), float(rng.random())) for d in range(nd) for t in set(rng.integers(0, V, 6).tolist()) | {0, 1}]
    dv += [(nd + i, t, w) for i, (d, t, w) in enumerate(dv[:5]) if d == 0]  # duplicate doc -> ties
    Q = spark.createDataFrame(qv, "query_id long, term_id long, w double")
    D = spark.createDataFrame(dv, "corpus_idx long, term_id long, w double")
    P = spark.createDataFrame([(q, int(rng.integers(0, nd))) for q in range(nq)], "query_id long, pos_idx long")
    a = {r["query_id"]: r["rank"] for r in R.positive_rank(sparse_scores(Q, D), P).collect()}
    b = {r["query_id"]: r["rank"] for r in bounded_rank(Q, D, P, nq).collect()}
    assert a == b
