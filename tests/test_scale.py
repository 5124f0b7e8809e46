"""What must not grow with the tables: broadcasts of table rows, cells of tiles."""

import duckdb
import pytest

from pairlane.plans import q_negatives
from pairlane.sources import fixtures

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def _parts(spark, tmp_path, keys):
    folder = str(tmp_path)
    spark.createDataFrame([(k, f"red ring {i}", f"Brand#{i % 3}", "SMALL STEEL", i, 1.5 * i) for i, k in enumerate(keys)],
                          PART).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return folder


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_part_are_never_broadcast(spark, tmp_path, monkeypatch):
    """A scan's size is that of its compressed file, which says little of its rows."""
    sf = _parts(spark, tmp_path, range(40))
    assert "Broadcast" not in _plan(fixtures.pairs(spark, sf, materialized=False))
    monkeypatch.setattr(q_negatives, "pairs", lambda s, d: fixtures.pairs(s, d, materialized=False))
    assert "Broadcast" not in _plan(q_negatives.cache_records(spark, sf))


def test_pairs_of_repeated_and_null_keys(spark, tmp_path):
    sf = _parts(spark, tmp_path, [0, 1, 1, 2, 3, None, 5, 5])
    got = fixtures.pairs(spark, sf, materialized=False).select("pair_id", "title_left", "title_right", "label", "is_hard_negative")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet/*.parquet'")
    want = con.execute(f"WITH {fixtures.PAIRS_SQL} SELECT pair_id, title_left, title_right, label, is_hard_negative FROM pairs").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_accent_fold_looks_characters_up(spark):
    """No regex over the tables: it would try each of hundreds of ranges at every character."""
    from pairlane.functions.text import fold_accents
    df = spark.createDataFrame([("Ⅷ é ﬁ 한 ½ áb",), ("plain",), (None,)], "t string")
    folded = df.select(fold_accents("t").alias("f"))
    # the class of what becomes several characters is left, asked only for single characters above ASCII
    assert folded._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 0
    assert [r[0] for r in folded.collect()] == ["VIII e fi 한 1⁄2 ab", "plain", None]


def test_a_query_goes_to_a_region_once(spark, monkeypatch):
    """Many balls, few regions, pieces of a ball that cannot be cut: as brute force."""
    import numpy as np

    from pairlane.plans import balls
    monkeypatch.setattr(balls, "BALL_ROWS", 8)
    monkeypatch.setattr(balls, "REGION_ROWS", 64)
    monkeypatch.setattr(balls, "QUERY_ROWS", 50)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((300, 4)), np.ones((150, 4))])
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "corpus_idx long, vec array<double>")
    q = rng.standard_normal((90, 4))
    s = np.round(q @ x.T, 9)
    asked = spark.createDataFrame([(i, v.tolist(), i, float(v @ x[i])) for i, v in enumerate(q)],
                                  "query_id long, vec array<double>, pos_idx long, s_pos double")
    order = [np.lexsort((np.arange(len(x)), -row)) for row in s]
    got = {r["query_id"]: r["rank"] for r in balls.bounded_rank(asked, corpus).collect()}
    assert got == {i: int(np.flatnonzero(o == i)[0]) + 1 for i, o in enumerate(order)}
    best = balls.bounded_topk(asked.select("query_id", "vec"), corpus, 12).collect()
    assert {(r["query_id"], r["rank"]): r["corpus_idx"] for r in best} == {(i, k + 1): int(o[k]) for i, o in enumerate(order) for k in range(12)}
    placed, b = balls.grow(corpus, len(x))
    assert len(b.first) < len(b.ids)
    routed = balls._route(asked.select("query_id", "vec"), b, lambda b, q, rows: (np.ones((len(q), len(b.ids)), bool), {}))
    assert routed.count() == 90 * len(b.first)
    assert placed.groupBy("region", "piece").count().agg({"count": "max"}).first()[0] <= 2 * 64


def test_sparse_scores_move_vectors_not_products(spark):
    """By hand, and without a shuffle of (query, document, term) rows."""
    from pairlane.operators.tfidf import sparse_scores
    qv = spark.createDataFrame([(7, 1, 0.5), (7, 2, 0.25), (9, 3, 1.0), (11, 8, 1.0)], "query_id long, term_id long, w double")
    dv = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (1, 2, 1.0), (2000, 3, 0.125), (2000, 1, 0.5)],
                               "corpus_idx long, term_id long, w double")
    got = sparse_scores(qv, dv)
    assert sorted(map(tuple, got.collect())) == [(7, 0, 0.375), (7, 1, 0.25), (7, 2000, 0.25), (9, 2000, 0.125)]
    assert "Join Inner, (term_id" not in got._jdf.queryExecution().optimizedPlan().toString()
