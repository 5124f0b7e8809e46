"""Every registered query with SQL equals its DuckDB oracle at sf0.001
(row count, column names, order-insensitive value hash); the few without SQL
have the shape that their definition asks for."""

import math

import pytest

import oracle
from conftest import SF0001
from pairlane.plans.common import pairs
from pairlane.plans.registry import all_queries, all_sql

SQL = all_sql()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF0001)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF0001)
    a = oracle.spark_digest(df)
    b = oracle.duck_digest(con, SQL[key])
    assert a[0] == b[0], f"rows {a[0]} vs {b[0]}"
    assert a[1] == b[1], f"columns {a[1]} vs {b[1]}"
    assert a[2] == b[2], oracle.first_diff(df, con, SQL[key])


def test_queries_without_sql():
    """Their results are tested in test_dense_stream."""
    assert set(QUERIES) - set(SQL) == {"encode_texts", "fit_contrastive_adapter", "epoch_sweep"}


def test_encode_texts_has_every_match(spark):
    got = {r.pair_id: r.vec for r in QUERIES["encode_texts"](spark, SF0001).collect()}
    assert set(got) == {r.pair_id for r in pairs(spark, SF0001).filter("label = 1").select("pair_id").collect()}
    assert all(len(v) == 64 and math.isclose(sum(x * x for x in v), 1, abs_tol=1e-5) for v in got.values())


def test_training_queries_take_every_step(spark):
    fit = sorted(map(tuple, QUERIES["fit_contrastive_adapter"](spark, SF0001).select("epoch", "steps", "loss").collect()))
    per = fit[0][1]
    assert [(e, s) for e, s, _ in fit] == [(1, per), (2, 2 * per), (3, 3 * per)]
    assert all(x > 0 for _, _, x in fit)
    sweep = {r.epochs: r for r in QUERIES["epoch_sweep"](spark, SF0001).collect()}
    assert {e: r.steps for e, r in sweep.items()} == {e: e * per for e in (3, 5, 10, 15)}
    assert all(0 < r.mrr <= 1 and r.acc_at_1 <= r.acc_at_5 for r in sweep.values())
