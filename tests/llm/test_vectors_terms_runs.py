"""Flat graph, segment trees and runs against brute force, with nulls, empty and
long rows, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

import oracle
from conftest import SF0001
from pairlane.llm import divergence, flat_graph, runs


# -- runs ---------------------------------------------------------------------

def runs_by_hand(w, least, periods):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, periods * q) and not any(
                    all(w[i + k] == w[i + k + p] for k in range(n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = [f"w{rng.randrange(rng.choice([1, 2, 3, 6]))}" for _ in range(rng.randrange(70))]
    if w and rng.random() < 0.6:
        a, p = rng.randrange(len(w)), rng.randint(1, 9)
        w = w[:a] + [w[min(len(w) - 1, a + k % p)] for k in range(len(w) - a)]
    return w


@pytest.mark.parametrize("reverse", [False, True])
def test_lyndon_lengths(reverse):
    rng = random.Random(2)
    for _ in range(400):
        ids = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(13))]
        line = [-x for x in ids] if reverse else ids
        want = [max(n for n in range(1, len(ids) - i + 1)
                    if all(line[i:i + n] < line[i + k:i + n] for k in range(1, n))) for i in range(len(ids))]
        assert runs.lyndon_lengths(ids, max(ids, default=-1) + 1, reverse) == want


@pytest.mark.parametrize("least,periods", [(6, 4), (2, 2), (5, 3)])
def test_word_runs(least, periods):
    rng = random.Random(periods)
    for _ in range(400):
        w = random_words(rng)
        assert runs.word_runs(w, least, periods) == runs_by_hand(w, least, periods)


def test_long_periodic_texts_stay_fast():
    assert runs.word_runs([b"a"] * 50_000) == [(0, 50_000, 1)]
    block = [b"a"] * 50 + [b"b"]
    got = runs.word_runs(block * 400)
    assert (0, 51 * 400, 51) in got and len(got) == 401


def expected_row(doc, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(w, 6, 4)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (doc, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def key(r):
    return tuple((x is not None, x) for x in r)


def test_runs_report(spark):
    rng = random.Random(5)
    rows = [(k, " \t\n"[k % 3].join(random_words(rng))) for k in range(150)]
    rows += [(None, "a b a b a b a b a b"), (7, None), (8, ""), (9, " \x0b "), (9, "x x x x x x"), (9, "x x x x x x"),
             (200, "tür 中 \U0001f600 " * 9), (201, "é" * 9000)]
    table = spark.createDataFrame([(i, t, k, "z") for k, (i, t) in enumerate(rows)],
                                  "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = sorted((tuple(r) for r in runs.report(table).collect()), key=key)
    assert got == sorted((expected_row(i, t) for i, t in rows), key=key)
    assert runs.report(table.limit(0)).collect() == []


def test_runs_general_output(spark):
    table = spark.createDataFrame([(1, "a b a b a b a b c")], "doc_id long, text string")
    r = runs.find_runs(table).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (9, [(0, 8, 2)], "a b c")


# -- segment trees ------------------------------------------------------------

def test_divergence_sql_on_tables(spark):
    con = oracle.duck(SF0001)
    assert oracle.spark_digest(divergence.audit(spark.read.parquet(f"{SF0001}/documents.parquet"))) == \
        oracle.duck_digest(con, divergence.AUDIT_SQL)


@pytest.mark.parametrize("block_terms,tile_groups", [(2048, 64), (8, 2), (1, 1)])
def test_divergence_edges(spark, block_terms, tile_groups):
    import duckdb
    rng = random.Random(3)
    words = ["alpha", "Beta", "ÉTÉ", "été", "中文", "x-y", "q'z", "zz", "Zz"] + [f"t{chr(97 + k)}" for k in range(20)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["en", "de", None, ""]),
             rng.choice(["a", "b", "b", "c", None, "é"])) for k in range(260)]
    rows += [(1, None, "en", "only-null"), (2, "", "fr", "solo"), (3, "rare rare", "fr", "solo2"), (3, "rare rare", "fr", "solo2")]
    table = spark.createDataFrame([(*r, 1, "v") for r in rows],
                                  "doc_id long, text string, lang string, source string, rank int, value string").repartition(3)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    got = divergence.audit(table, block_terms=block_terms, tile_groups=tile_groups)
    assert oracle.spark_digest(got) == oracle.duck_digest(con, divergence.AUDIT_SQL)


def test_divergence_empty(spark):
    t = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(t).collect() == []


def test_forest_shares_and_prices_once():
    forest = divergence.Forest(1000)
    a, b = forest.tree({}), forest.tree({})
    assert a == b and len(forest.nodes) < 40  # all zero: one chain of nodes
    walk = divergence.Walk(forest, 1000)
    p, q = divergence.share(0, 10, 1000), divergence.share(0, 30, 1000)
    assert walk.price(a, b, walk.shares(10), walk.shares(30)) == (1000 * ((p - q) ** 2 // (p + q)), 1)
    c = forest.tree({0: 5, 999: 5})
    walk = divergence.Walk(forest, 1000)
    value, priced = walk.price(a, c, walk.shares(10), walk.shares(30))
    assert priced == 2 and value > 0  # a thousand terms, two different pairs of leaves


def test_counts_beyond_64_bits():
    big = 1 << 62
    assert divergence.share(big, big, 1) == 1 + divergence.SCALE * (big + 2) // (big + 2)


# -- flat graph ---------------------------------------------------------------

def links_by_hand(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (i, j))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    near[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), comp, comp == rows[i][0]))
    return sorted(out, key=key)


def vectors(rng, n, dims, noise=0.02):
    base = rng.normal(size=(max(1, n // 6), dims))
    return [(base[rng.integers(len(base))] + noise * rng.normal(size=dims) * np.sqrt(dims)).tolist() for _ in range(n)]


def test_near_vectors_edges(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = list(enumerate(vectors(rng, 150, 16)))
    rows += [(900 + k, [3.0 * x for x in rows[0][1]]) for k in range(2)]  # scaled: cosine 1
    rows += [(950, rows[1][1]), (950, rows[1][1]), (None, rows[1][1]), (None, [-1.0] * 16)]
    rows += [(960, None), (961, []), (962, [0.0] * 16), (963, [1.0, None] * 8), (964, [float("nan")] * 16),
             (965, [float("inf")] * 16), (966, [1.0, 0.0]), (967, [1.0, 0.01]), (968, [1e200, 1e198]), (969, [5.0])]
    table = spark.createDataFrame([(i, v, 0, "s") for i, v in rows],
                                  "vec_id long, embedding array<double>, label int, shard string").repartition(3)
    want = links_by_hand(rows)
    assert sorted((tuple(r) for r in flat_graph.near_duplicates(table).collect()), key=key) == want
    monkeypatch.setattr(flat_graph, "SHARD_ROWS", 20)
    monkeypatch.setattr(flat_graph, "TILE_ROWS", 25)
    assert sorted((tuple(r) for r in flat_graph.near_duplicates(table).collect()), key=key) == want


def test_near_vectors_empty(spark):
    t = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert flat_graph.near_duplicates(t).collect() == []


def test_graph_recall_on_one_dense_group():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    x = np.concatenate([centre + 0.1 * rng.normal(size=(900, 64)), rng.normal(size=(2000, 64))])
    x = flat_graph.unit(x).astype(np.float32)
    found = flat_graph.in_range(x, flat_graph.build(x), x, 0.95, flat_graph.SEARCH_BEAM)
    truth = x @ x.T >= 0.95
    assert sum(len(f) for f in found) >= 0.99 * truth.sum()
    assert all(truth[k, f].all() or (x[f] @ x[k]).min() > 0.9499 for k, f in enumerate(found) if len(f))


def test_audit_widens_a_poor_search(spark, monkeypatch):
    """With next to no margin and beam the first search loses links; the audit
    sees it and the last result is whole."""
    rng = np.random.default_rng(8)
    rows = list(enumerate(vectors(rng, 400, 6, 0.05)))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(flat_graph, "SHARD_ROWS", 30)
    monkeypatch.setattr(flat_graph, "DEVIATIONS", 0.3)
    monkeypatch.setattr(flat_graph, "LEAST_RECALL", 1.0)
    margins = []
    search = flat_graph.search
    monkeypatch.setattr(flat_graph, "search", lambda *a: margins.append(a[2]) or search(*a))
    got = sorted((tuple(r) for r in flat_graph.near_duplicates(table).collect()), key=key)
    assert len(margins) > 1 and got == links_by_hand(rows)
