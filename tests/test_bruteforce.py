"""Spark results against brute force on small random inputs."""

import numpy as np
import pandas as pd
import pytest

from pairlane.operators.dense import dense_rank, dense_topk
from pairlane.plans import balls, maxscore, setjoin


@pytest.fixture(autouse=True)
def spread_partitions(spark):
    """Keep every shuffle partition: with coalescing on, tiny inputs collapse
    into one partition and would hide cogroup key mismatches between the two
    sides of a tile."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, old)


def _random_case(seed, nq=40, nd=70, V=30):
    rng = np.random.default_rng(seed)
    Q = np.zeros((nq, V))
    D = np.zeros((nd, V))
    for i in range(nq):
        t = rng.choice(V, rng.integers(1, 6), replace=False)
        Q[i, t] = rng.random(len(t))
    for j in range(nd):
        t = rng.choice(V, rng.integers(0, 6), replace=False)  # some empty docs
        D[j, t] = rng.integers(1, 4, len(t)) / 4.0            # coarse weights -> ties
    D[5] = D[7]                                                # identical documents
    D[:, 0] = np.where(rng.random(nd) < 0.9, 0.5, 0.0)         # a hot term
    pos = rng.integers(0, nd, nq)
    return Q, D, pos


def _df(spark, M, id_col):
    rows = [(i, j, float(M[i, j])) for i in range(M.shape[0]) for j in range(M.shape[1]) if M[i, j] > 0]
    return spark.createDataFrame(rows, f"{id_col} long, term_id long, w double")


def _brute_ranks(Q, D, pos):
    S = np.round(Q @ D.T, 9)
    out = {}
    for i in range(len(Q)):
        order = sorted(range(D.shape[0]), key=lambda j: (-S[i, j], j))
        out[i] = order.index(int(pos[i])) + 1
    return out


@pytest.mark.parametrize("block,chunk", [(4096, 4096), (16, 7), (1, 1000)])
@pytest.mark.parametrize("seed", [0, 1])
def test_ranks_match_brute_force(spark, monkeypatch, seed, block, chunk):
    monkeypatch.setattr(maxscore, "BLOCK_DOCS", block)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", chunk)
    Q, D, pos = _random_case(seed)
    Q[3] = 0  # no term at all
    Q[4], D[:, 29], pos[4] = 0, 0, 40
    Q[4, 29] = 1.0  # only a term that no document has
    qv, dv = _df(spark, Q, "query_id"), _df(spark, D, "corpus_idx")
    P = spark.createDataFrame([(i, int(p)) for i, p in enumerate(pos)], "query_id long, pos_idx long")
    got = {r["query_id"]: r["rank"] for r in maxscore.bounded_rank(qv, dv, P, len(Q)).collect()}
    assert got == _brute_ranks(Q, D, pos)


def _brute_topk(Q, D, k, gone=()):
    S = np.round(Q @ D.T, 9)
    out = {}
    for i in range(len(Q)):
        cand = [j for j in range(D.shape[0]) if (i, j) not in gone]
        for r, j in enumerate(sorted(cand, key=lambda j: (-S[i, j], j))[:k], 1):
            out[i, r] = (j, S[i, j])
    return out


@pytest.mark.parametrize("block,chunk,k", [(4096, 4096, 4), (16, 7, 4), (16, 4096, 1), (8, 9, 100)])
def test_topk_matches_brute_force(spark, monkeypatch, block, chunk, k):
    monkeypatch.setattr(maxscore, "BLOCK_DOCS", block)
    monkeypatch.setattr(maxscore, "QUERY_ROWS", chunk)
    Q, D, _ = _random_case(3)
    Q[3] = 0
    qv, dv = _df(spark, Q, "query_id"), _df(spark, D, "corpus_idx")
    ids = spark.range(len(Q)).withColumnRenamed("id", "query_id")
    rng = np.random.default_rng(1)
    # excluded pairs, among them the best ones, and one query with all documents excluded
    gone = {(i, j) for i in range(0, len(Q), 2) for j in rng.choice(D.shape[0], 20, replace=False).tolist()}
    gone |= {(i, j) for (i, r), (j, _) in _brute_topk(Q, D, 3).items() if i % 3 == 0}
    gone |= {(8, j) for j in range(D.shape[0])}
    for excluded in (set(), gone):
        exclude = spark.createDataFrame([(int(i), int(j)) for i, j in excluded], "query_id long, corpus_idx long") \
            if excluded else None
        rows = maxscore.bounded_topk(qv, dv, ids, k, len(Q), D.shape[0], exclude).collect()
        got = {(r["query_id"], r["rank"]): (r["corpus_idx"], round(r["score"], 9)) for r in rows}
        assert len(rows) == len(got)
        want = _brute_topk(Q, D, k, excluded)
        assert {key: v[0] for key, v in got.items()} == {key: v[0] for key, v in want.items()}
        assert all(abs(got[key][1] - want[key][1]) < 1e-8 for key in want)


def test_only_documents_in_reach_are_scored():
    """With a score to beat, the postings of frequent terms with small bounds are
    not walked and few documents are scored."""
    docs = pd.DataFrame({"corpus_idx": range(2000), "term_ids": [[0, 1, 2 + i % 500] for i in range(2000)],
                         "weights": [[0.1, 0.1, 0.9] for _ in range(2000)]})
    block = maxscore.Block(docs)
    places, score = block.reach(np.array([0, 1, 77]), np.array([0.1, 0.1, 0.9]), 0.5)
    assert len(places) == 4 and set(block.idx[places] % 500) == {75} and (score == 0.83).all()
    assert len(block.reach(np.array([0, 1]), np.array([0.1, 0.1]), 0.5)[0]) == 0


@pytest.mark.parametrize("block,k", [(2048, 3), (16, 3), (7, 40)])
def test_group_jaccard_topk_matches_brute_force(spark, monkeypatch, block, k):
    monkeypatch.setattr(setjoin, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    n, V = 120, 25
    toks = [[f"t{x}" for x in rng.integers(0, V, rng.integers(0, 9))] for _ in range(n)]
    grp = ["large" if i % 2 else f"b{int(g)}" for i, g in enumerate(rng.integers(0, 9, n))]
    grp[5] = grp[9] = None
    table = spark.createDataFrame([(i, toks[i], grp[i]) for i in range(n)], "key long, toks array<string>, grp string")
    rows, flat = setjoin.numbered(table, "key", "grp", "toks")
    key_of = {r["idx"]: r["key"] for r in rows.collect()}
    got = {(key_of[r["query_id"]], r["rank"]): (key_of[r["corpus_idx"]], r["score"]) for r in setjoin.group_topk(flat, k).collect()}
    want = {}
    for i in range(n):
        a, cand = set(toks[i]), []
        for j in range(n):
            b = set(toks[j])
            if j != i and grp[i] is not None and grp[j] == grp[i] and a & b:
                cand.append((-round(len(a & b) / len(a | b), 9), j))
        want |= {(i, r): (j, -s) for r, (s, j) in enumerate(sorted(cand)[:k], 1)}
    assert got == want


def _dense_case(seed, clusters, n=300, dims=8, spread=0.1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((clusters, dims)) * 2
    C = centre[rng.integers(clusters, size=n)] + spread * rng.standard_normal((n, dims))
    C[7] = C[3]  # ties
    C[200:260] = C[200]  # a ball that no centre can cut
    return centre[rng.integers(clusters, size=40)] + spread * rng.standard_normal((40, dims)), C, rng


def _dense_frames(spark, Q, C, **more):
    q = [(i, Q[i].tolist(), *[m[0][i] for m in more.values()]) for i in range(len(Q))]
    c = [(i, C[i].tolist(), *[m[1][i] for m in more.values()]) for i in range(len(C))]
    extra = "".join(f", {k} string" for k in more)
    return (spark.createDataFrame(q, f"query_id long, vec array<double>{extra}"),
            spark.createDataFrame(c, f"corpus_idx long, vec array<double>{extra}"))


@pytest.mark.parametrize("rows,k", [(1024, 3), (16, 3), (16, 500)])
def test_dense_topk_brute_force(spark, monkeypatch, rows, k):
    monkeypatch.setattr(balls, "BALL_ROWS", rows)
    monkeypatch.setattr(balls, "QUERY_ROWS", 3 * rows)
    Q, C, rng = _dense_case(3, 12)
    groups = [rng.choice(["a", "b", None], size=len(m)).tolist() for m in (Q, C)]
    S = np.round(Q @ C.T, 9)
    for more in ({}, {"grp": groups}):
        got = {(r["query_id"], r["rank"]): r["corpus_idx"] for r in dense_topk(*_dense_frames(spark, Q, C, **more), k).collect()}
        want = {}
        for i in range(len(Q)):
            free = [j for j in range(len(C)) if not more or groups[0][i] != groups[1][j]]
            want |= {(i, r): j for r, j in enumerate(sorted(free, key=lambda j: (-S[i, j], j))[:k], 1)}
        assert got == want


@pytest.mark.parametrize("rows", [1024, 16])
def test_dense_ranks_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(balls, "BALL_ROWS", rows)
    Q, C, rng = _dense_case(4, 12)
    pos = rng.integers(len(C), size=len(Q))
    S = np.round(Q @ C.T, 9)
    q, c = _dense_frames(spark, Q, C)
    q = q.join(spark.createDataFrame([(i, int(p)) for i, p in enumerate(pos)], "query_id long, pos_idx long"), "query_id")
    rows_ = dense_rank(q, c).collect()
    assert {r["query_id"]: r["rank"] for r in rows_} == {
        i: 1 + sorted(range(len(C)), key=lambda j: (-S[i, j], j)).index(int(pos[i])) for i in range(len(Q))}
    if rows == 16:  # clustered vectors: most balls are passed over or counted whole
        assert sum(r["visited"] for r in rows_) < 0.4 * len(Q) * len(C)


def test_ball_bounds_hold():
    rng = np.random.default_rng(6)
    members = rng.standard_normal((50, 5)) * rng.random((50, 1)) * 3
    centre = members.mean(axis=0)
    norms = np.linalg.norm(members, axis=1)
    b = balls.Balls([{"ball": 0, "centre": centre, "radius": np.linalg.norm(members - centre, axis=1).max(),
                      "low": norms.min(), "high": norms.max(), "n": 50}])
    q = rng.standard_normal((200, 5))
    least, most = b.score_bounds(q)
    score = q @ members.T
    assert (least[:, 0] <= score.min(axis=1) + 1e-9).all() and (most[:, 0] >= score.max(axis=1) - 1e-9).all()
