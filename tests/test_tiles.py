"""What a search over blocks may not make grow: plans, copies of blocks."""

import numpy as np
import pandas as pd

from pairlane.plans import maxscore


def _vectors(spark, n, id_col, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, int(t), float(rng.random())) for i in range(n) for t in rng.choice(20, 4, replace=False)]
    return spark.createDataFrame(rows, f"{id_col} long, term_id long, w double")


def test_plans_do_not_repeat_those_of_kept_tables(spark):
    """Spark reports a plan with the plans of all kept tables below it, each time that one is read."""
    qv, dv = _vectors(spark, 30, "query_id", 1).cache(), _vectors(spark, 50, "corpus_idx", 2).cache()
    ids = spark.range(30).withColumnRenamed("id", "query_id")
    for df in (maxscore.bounded_topk(qv, dv, ids, 3, 30, 50), maxscore.bounded_topk(qv, dv, ids, 3, 30, 50, ids.selectExpr("query_id", "query_id AS corpus_idx"))):
        assert df.count() == 90
        assert len(df._jdf.queryExecution().executedPlan().toString()) < 20_000


def test_documents_go_to_the_chunks_of_their_own_block(spark, monkeypatch):
    """Not to one for each chunk that all queries together would fill."""
    monkeypatch.setattr(maxscore, "QUERY_ROWS", 4)
    monkeypatch.setattr(maxscore, "LEAST_ROWS", 4)
    asked = spark.range(44).selectExpr("id AS query_id", "least(id DIV 4, 9) AS block")
    docs = spark.range(40).selectExpr("id AS corpus_idx", "id DIV 4 AS block")

    def cell(key, q, d):
        return pd.DataFrame({"block": [int(key[0])], "nq": [len(q)], "nd": [len(d)]})

    got = maxscore._meet(asked, asked.select("query_id"), docs, cell, "block long, nq long, nd long").toPandas()
    assert got["nq"].sum() == 44 and (got["nd"] == 4).all()
    assert (got.groupby("block").size() == np.array([1] * 9 + [2])).all()


def test_block_finds_what_reaches_the_score():
    """Groups, stripes, columns of frequent terms and documents without terms, as by hand."""
    rng = np.random.default_rng(3)
    M = np.where(rng.random((700, 40)) < np.linspace(0.01, 0.6, 40), rng.integers(1, 5, (700, 40)) / 4.0, 0.0)
    order = rng.permutation(700)
    docs = pd.DataFrame({"corpus_idx": np.arange(700), "place": order, "term_ids": [np.flatnonzero(r) for r in M],
                         "weights": [r[r > 0] for r in M]})
    for few in (1024, 3):
        maxscore_few, maxscore.FEW = maxscore.FEW, few
        try:
            block = maxscore.Block(docs)
            for _ in range(60):
                ids = np.sort(rng.choice(45, 6, replace=False))  # some are in no document
                w = rng.random(6)
                want = np.round(M[:, ids[ids < 40]] @ w[ids < 40], 9)
                for beat in (0.0, 0.5, 1.5, 9.0):
                    places, score = block.reach(ids, w, beat)
                    found = dict(zip(block.idx[places].tolist(), score))
                    assert found.keys() == set(np.flatnonzero((want > 0) & (want >= beat)).tolist())
                    assert all(abs(want[i] - s) < 2e-9 for i, s in found.items())
                places, score = block.reach(ids, w, 0.0, 5)
                assert np.allclose(np.sort(score)[-5:], np.sort(want)[-5:], atol=2e-9)
        finally:
            maxscore.FEW = maxscore_few
