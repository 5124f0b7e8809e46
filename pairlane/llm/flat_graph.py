"""Near duplicates among vectors by a robust-pruned flat graph.

Vectors with the same components are one class, and only classes are compared.
Centroids are fitted on a bounded sample; a class is at home in the shard of its
nearest centroid and also lies in every shard whose border is within ``margin``
of it, so shards overlap.  A shard too large for a task is dealt into tiles.

In each tile a graph is built by inserting its members in batches: a greedy
search from the medoids finds a member's surroundings, robust pruning keeps the
neighbours that no kept one stands in for, and back edges are pruned alike.  The
lists that a class has in its tiles are united, and members search the tiles of
their home shard on these lists: greedily from the medoids and from their own
neighbours, then expanding every node in range until no new one appears.  What is found is verified by the cosine
in double precision.

A link is counted in the home shard of its smaller class, so counts are summed
and no list of pairs is made.  The links of a bounded sample are then audited
against all classes; where the recall falls short, margin and beam are doubled
and everything is searched again.  With the margin at the distance of a pair on
the threshold, no linked pair is without a common shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.llm.common import stored
from pairlane.llm.ngram_join import components
from pairlane.plans.indexing import dense_index

#: Classes at home in a shard (on average), members of a tile, centroids.
SHARD_ROWS, TILE_ROWS, MAX_SHARDS = 4096, 8192, 2048
#: Sampled classes for centroids and for the audit, and the recall it asks for.
SAMPLE_ROWS, AUDIT_ROWS, LEAST_RECALL = 16_384, 1024, 0.98
#: Neighbours of a node, beam of building, slack of pruning, starts of a search.
DEGREE, BEAM, ALPHA, STARTS = 16, 24, 1.2, 8
#: Neighbours that must list a node in return, and the first beam of a search.
MUTUAL, SEARCH_BEAM = 4, 32
#: Queries that search together.
TOGETHER = 512
#: Nodes this far below the threshold are expanded too.
SLACK = 0.05
#: First margin, in standard deviations of a linked pair's random displacement.
DEVIATIONS = 2.5


# -- the graph ----------------------------------------------------------------

def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def medoids(x: np.ndarray, starts: int = STARTS) -> np.ndarray:
    """The member nearest to the mean, then members far from those before."""
    first = int((x @ x.mean(axis=0)).argmax())
    chosen, nearest = [first], x @ x[first]
    for _ in range(min(starts, len(x)) - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return np.unique(chosen)


def greedy(x: np.ndarray, lists: np.ndarray, q: np.ndarray, starts: np.ndarray,
           beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities) of the ``beam`` best nodes that each row of ``q``
    meets from ``starts`` (and its places in ``own``); -1 and -inf where there are
    fewer.  All rows step together."""
    b = len(q)
    ids = np.broadcast_to(starts, (b, len(starts))).copy()
    if own is not None:
        ids = np.concatenate([ids, own], axis=1)
    sims = np.einsum("bcd,bd->bc", x[ids], q).astype(np.float32)
    sims[ids < 0] = -np.inf
    _distinct(ids, sims, np.full(b, -2))
    width = max(beam, len(starts))
    met = np.zeros((b, len(x)), bool)
    r, c = np.nonzero(ids >= 0)
    met[r, ids[r, c]] = True
    if ids.shape[1] < width:
        more = ((0, 0), (0, width - ids.shape[1]))
        ids, sims = np.pad(ids, more, constant_values=-1), np.pad(sims, more, constant_values=-np.inf)
    top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
    is_open = sims > -np.inf
    while True:
        best = np.where(is_open, sims, -np.inf)
        pick = best.argmax(axis=1)
        rows = np.flatnonzero(best[np.arange(b), pick] > -np.inf)
        if not len(rows):
            return ids, sims
        is_open[rows, pick[rows]] = False
        around = lists[ids[rows, pick[rows]]]
        r, c = np.nonzero((around >= 0) & ~met[rows[:, None], around])
        new = around[r, c]
        met[rows[r], new] = True
        # only what is new, moved to the left
        many = np.bincount(r, minlength=len(rows))
        c = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
        around = np.full((len(rows), max(1, int(many.max()))), -1)
        around[r, c] = new
        near = np.full(around.shape, -np.inf, np.float32)
        near[r, c] = np.einsum("kd,kd->k", x[new], q[rows[r]])
        all_sims = np.concatenate([sims[rows], near], axis=1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[rows] = np.take_along_axis(all_sims, top, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], around], axis=1), top, 1)
        is_open[rows] = np.take_along_axis(np.concatenate([is_open[rows], near > -np.inf], axis=1), top, 1)


def robust_prune(x: np.ndarray, around: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of the candidates of each row (places, -1 for none, and similarities): the
    nearest, again and again, without those that it is ``alpha`` times nearer to."""
    rows = np.arange(len(around))
    vectors = x[around]
    far = 2 - 2 * sims
    left = (around >= 0) & (sims > -np.inf)
    out = np.full((len(around), degree), -1)
    for k in range(degree):
        if not left.any():
            break
        pick = np.where(left, sims, -np.inf).argmax(axis=1)
        some = left[rows, pick]
        out[some, k] = around[rows, pick][some]
        left[rows, pick] = False
        between = 2 - 2 * np.einsum("bcd,bd->bc", vectors, vectors[rows, pick])
        left &= ~((alpha * between <= far) & some[:, None])
    return out


def _distinct(around: np.ndarray, sims: np.ndarray, own: np.ndarray) -> None:
    """Blanks the row's own place and repeated places."""
    order = np.argsort(around, axis=1, kind="stable")
    sorted_ = np.take_along_axis(around, order, 1)
    again = np.zeros(around.shape, bool)
    np.put_along_axis(again, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
    gone = again | (around == own[:, None])
    around[gone] = -1
    sims[gone] = -np.inf


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> np.ndarray:
    """Neighbour places of every row of ``x`` (unit vectors); -1 for none."""
    n, starts = len(x), medoids(x)
    lists = np.full((n, degree), -1)
    order = np.random.RandomState(0).permutation(n)
    inside = np.isin(order, starts)
    order, at, size = np.concatenate([order[inside], order[~inside]]), 0, len(starts)
    while at < n:
        batch = order[at:at + size]
        around, sims = greedy(x, lists, x[batch], starts, beam)
        # members of one batch do not see each other in the graph yet
        among = x[batch] @ x[batch].T
        some = min(8, len(batch))
        near = np.argpartition(-among, some - 1, axis=1)[:, :some]
        around = np.concatenate([around, batch[near]], axis=1)
        sims = np.concatenate([sims, np.take_along_axis(among, near, 1)], axis=1)
        _distinct(around, sims, batch)
        lists[batch] = robust_prune(x, around, sims, degree, alpha)
        _link_back(x, lists, batch, degree, alpha)
        at, size = at + size, min(2 * size, TOGETHER)
    return _mutual(lists, MUTUAL)


def _link_back(x: np.ndarray, lists: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    r, c = np.nonzero(lists[batch] >= 0)
    source, target = batch[r], lists[batch[r], c]
    fresh = ~(lists[target] == source[:, None]).any(axis=1)
    source, target = source[fresh], target[fresh]
    if not len(source):
        return
    sims = np.einsum("kd,kd->k", x[source], x[target])
    order = np.lexsort((-sims, target))
    source, target, sims = source[order], target[order], sims[order]
    nodes, first = np.unique(target, return_index=True)
    place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    near = place < 3 * degree  # the nearest suffice for pruning
    row = np.searchsorted(nodes, target[near])
    room = int(place[near].max()) + 1
    around = np.full((len(nodes), degree + room), -1)
    around[:, :degree] = lists[nodes]
    around[row, degree + place[near]] = source[near]
    for a in range(0, len(nodes), TOGETHER):
        own, some = nodes[a:a + TOGETHER], around[a:a + TOGETHER]
        near_sims = np.einsum("bcd,bd->bc", x[some], x[own]).astype(np.float32)
        near_sims[some < 0] = -np.inf
        lists[own] = robust_prune(x, some, near_sims, degree, alpha)


def _mutual(lists: np.ndarray, least: int) -> np.ndarray:
    """``lists``, wider where needed, with every node on the lists of at least
    ``least`` of its own neighbours: in a dense group everyone prefers the same
    central members, and an outer one would be on no list.  Of the neighbours the
    least burdened take it."""
    n = len(lists)
    source, place = np.nonzero(lists >= 0)
    target = lists[source, place]
    both = np.isin(source * n + target, target * n + source)
    lacking = least - np.bincount(source[both], minlength=n)
    added, burden = [[] for _ in range(n)], np.zeros(n, np.int64)
    open_ = np.split(target[~both], np.searchsorted(source[~both], np.arange(1, n)))
    for node in np.flatnonzero(lacking > 0):
        near = open_[node]
        for t in near[np.argsort(burden[near], kind="stable")[:lacking[node]]]:
            added[t].append(node)
            burden[t] += 1
    wide = np.full((n, lists.shape[1] + int(burden.max(initial=0))), -1)
    wide[:, :lists.shape[1]] = lists
    for t in np.flatnonzero(burden):
        wide[t, lists.shape[1]:lists.shape[1] + len(added[t])] = added[t]
    return wide


def in_range(x: np.ndarray, lists: np.ndarray, q: np.ndarray, least: float, beam: int,
             own: np.ndarray | None = None) -> list[np.ndarray]:
    """Places within ``least`` that each row of ``q`` finds: a greedy search from the
    medoids (and from the row's neighbours in the graph, ``own``), then every node
    in range (or a little below) is expanded until nothing is new."""
    out, starts = [], medoids(x)
    for a in range(0, len(q), TOGETHER):
        ids, sims = greedy(x, lists, q[a:a + TOGETHER], starts, beam, None if own is None else own[a:a + TOGETHER])
        near = (ids >= 0) & (sims >= least - SLACK)
        for k, row in enumerate(near):
            met = np.zeros(len(x), bool)
            front = ids[k][row]
            met[ids[k][ids[k] >= 0]] = True
            found = [ids[k][(ids[k] >= 0) & (sims[k] >= least - 1e-5)]]
            if len(front) > 1:  # alone, it has been expanded already
                while len(front):
                    new = np.unique(lists[front])
                    new = new[(new >= 0)]
                    new = new[~met[new]]
                    met[new] = True
                    s = x[new] @ q[a + k]
                    found.append(new[s >= least - 1e-5])
                    front = new[s >= least - SLACK]
            out.append(np.concatenate(found))
    return out


# -- shards -------------------------------------------------------------------

def fit_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of the sampled unit vectors ``x``."""
    c = x[np.random.RandomState(0).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.bincount(own, minlength=len(c))
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    return c


def shards_of(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is home) of unit vectors: the nearest centroid, and those whose
    border to it lies within ``margin``."""
    far = (c * c).sum(axis=1) - 2 * x @ c.T
    home = far.argmin(axis=1)
    between = np.sqrt(np.maximum(((c[home][:, None] - c[None]) ** 2).sum(axis=2), 1e-18)) if len(c) <= 64 else \
        np.sqrt(np.maximum((c * c).sum(axis=1)[home][:, None] + (c * c).sum(axis=1) - 2 * c[home] @ c.T, 1e-18))
    gap = (far - far[np.arange(len(x)), home][:, None]) / (2 * between)
    row, shard = np.nonzero((gap <= margin) | (np.arange(len(c)) == home[:, None]))
    return row, shard, home[row] == shard


def _vectors(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def classes_of(vectors: DataFrame) -> DataFrame:
    """cid (dense), dims, x, copies and first (smallest vec_id) of the distinct
    vectors that can link: finite, without nulls, not zero.  Components are
    scaled by their largest, so that no square overflows."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    good = (rows.where("x IS NOT NULL AND size(x) > 0").where(finite)
            .where(F.exists("x", lambda v: v != 0)))
    named = (good.groupBy("x").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
             .select("copies", "first", F.size("x").alias("dims"), "x", F.xxhash64("x").alias("h")))
    return stored(dense_index(named, ["h"], "cid").drop("h"), "classes")


def members_of(classes: DataFrame, centroids: dict[int, np.ndarray], margin: dict[int, float]) -> DataFrame:
    """Every class once for each shard that it lies in, with its tile of that shard."""
    shared = classes.sparkSession.sparkContext.broadcast((centroids, margin))

    def run(batches):
        models, margins = shared.value
        for pdf in batches:
            for dims, part in pdf.groupby("dims"):
                c = models.get(int(dims))
                step = max(1, (1 << 21) // (len(c) if c is not None else 1))
                for a in range(0, len(part), step):
                    some = part.iloc[a:a + step]
                    x = unit(_scaled(_vectors(some["x"])))
                    row, shard, home = shards_of(x, c if c is not None else np.zeros((1, int(dims))), margins.get(int(dims), 0))
                    out = some.iloc[row][["cid", "dims", "copies", "x"]].copy()
                    out["shard"], out["home"] = shard, home
                    yield out[["dims", "shard", "cid", "copies", "home", "x"]]

    schema = "dims int, shard int, cid long, copies long, home boolean, x array<double>"
    members = stored(classes.select("cid", "dims", "copies", "x").mapInPandas(run, schema), "members")
    sizes = (members.groupBy("dims", "shard").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles")))
    return members.join(sizes, ["dims", "shard"]).withColumn("tile", F.pmod(F.xxhash64("cid"), "tiles").cast("int"))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.abs(x).max(axis=1, initial=0)[:, None]


# -- the search ---------------------------------------------------------------

def _build_tile(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cid")
    names = pdf["cid"].to_numpy()
    lists = build(unit(_scaled(_vectors(pdf["x"]))).astype(np.float32))
    return pd.DataFrame({"cid": names, "near": [names[row[row >= 0]] for row in lists]})


def _local_lists(names: np.ndarray, near, own: np.ndarray) -> np.ndarray:
    """Places of the listed classes that are in the tile (``names`` ascends),
    without the rows' ``own``."""
    sizes = [0 if n is None else len(n) for n in near]
    flat = np.concatenate([np.asarray(n, np.int64) for n in near if n is not None and len(n)] or [np.zeros(0, np.int64)])
    row = np.repeat(np.arange(len(own)), sizes)
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    ok = (names[at] == flat) & (flat != own[row])
    row, at = row[ok], at[ok]
    width = np.bincount(row, minlength=len(own))
    lists = np.full((len(own), max(1, int(width.max(initial=0)))), -1)
    first = np.concatenate([[0], np.cumsum(width)[:-1]])
    lists[row, np.arange(len(row)) - first[row]] = at
    return lists


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    while True:
        up = parent[nodes]
        if (parent[up] == up).all():
            return up
        parent[nodes] = parent[up]


def _search_tile(least: float, beam: int):
    def run(key, nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"cid": [], "n": [], "root": []})
        if not len(nodes) or not len(queries):
            return none
        nodes, queries = nodes.sort_values("cid"), queries.sort_values("cid")
        names, asked = nodes["cid"].to_numpy(), queries["cid"].to_numpy()
        lists, starts = _local_lists(names, nodes["near"], names), _local_lists(names, queries["near"], asked)
        x, q = _scaled(_vectors(nodes["x"])), _scaled(_vectors(queries["x"]))
        norm_x, norm_q = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        found = in_range(unit(x).astype(np.float32), lists, unit(q).astype(np.float32), least, beam, starts)
        linked = np.zeros((len(asked), len(names)), bool)
        for k, places in enumerate(found):
            linked[k, places[(x[places] @ q[k]) / (norm_x[places] * norm_q[k]) >= least]] = True
        at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
        if (names[at] == asked).all():  # a tile against itself: a link found from one end is one from both
            linked[:, at] |= linked[:, at].T
        linked &= names != asked[:, None]
        everyone = np.union1d(names, asked)
        of_name, of_asked = np.searchsorted(everyone, names), np.searchsorted(everyone, asked)
        parent, n = np.arange(len(everyone)), np.zeros(len(everyone), np.int64)
        copies_x, copies_q = nodes["copies"].to_numpy(), queries["copies"].to_numpy()
        for k in np.flatnonzero(linked.any(axis=1)):
            hit = np.flatnonzero(linked[k])
            tops = np.unique(_roots(parent, np.append(of_name[hit], of_asked[k])))
            parent[tops] = tops[0]
            hit = hit[names[hit] > asked[k]]  # counted where the smaller one is at home
            n[of_asked[k]] += copies_x[hit].sum()
            n[of_name[hit]] += copies_q[k]
        root = _roots(parent, np.arange(len(everyone)))
        some = (n > 0) | (root != np.arange(len(everyone)))
        return pd.DataFrame({"cid": everyone[some], "n": n[some], "root": everyone[root[some]]})
    return run


def search(classes: DataFrame, centroids: dict[int, np.ndarray], margin: dict[int, float],
           least: float, beam: int) -> DataFrame:
    """cid, n (rows linked with it) and root (a class it is connected with) in
    partial rows."""
    members = stored(members_of(classes, centroids, margin), "tiles")
    lists = (members.groupBy("dims", "shard", "tile").applyInPandas(_build_tile, "cid long, near array<long>"))
    united = stored(lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    tiles = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    members = members.join(united, "cid")
    nodes = members.withColumn("j", F.col("tile")).withColumn("i", tiles)
    key = ["dims", "shard", "i", "j"]
    queries = members.where("home").withColumn("i", F.col("tile")).withColumn("j", tiles)
    queries = queries.select(*[F.col(c).alias(c) for c in (*key, "cid", "copies", "x", "near")])  # columns of their own
    return stored(nodes.select(*key, "cid", "copies", "x", "near").groupBy(*key)
                  .cogroup(queries.groupBy(*key))
                  .applyInPandas(_search_tile(least, beam), "cid long, n long, root long"), "links")


def audit_recall(classes: DataFrame, links: DataFrame, least: float) -> float:
    """Share of the links of ``AUDIT_ROWS`` classes, in order of a hash, that
    ``links`` holds; the truth is a scan of all classes."""
    sample = classes.select("cid", "dims", "x").orderBy(F.xxhash64("cid")).limit(AUDIT_ROWS).toPandas()
    truth = dict.fromkeys(sample["cid"].tolist(), 0)
    by_dims = {int(d): (p["cid"].to_numpy(), _scaled(_vectors(p["x"]))) for d, p in sample.groupby("dims")}
    shared = classes.sparkSession.sparkContext.broadcast(by_dims)

    def run(batches):
        total: dict[int, int] = {}
        for pdf in batches:
            for dims, part in pdf.groupby("dims"):
                if int(dims) not in shared.value:
                    continue
                asked, q = shared.value[int(dims)]
                x = _scaled(_vectors(part["x"]))
                cos = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1))
                hit = (cos >= least) & (asked[:, None] != part["cid"].to_numpy())
                for c, n in zip(asked, hit @ part["copies"].to_numpy()):
                    if n:
                        total[int(c)] = total.get(int(c), 0) + int(n)
        yield pd.DataFrame({"cid": list(total), "n": list(total.values())}, dtype="int64")

    rows = classes.select("cid", "dims", "copies", "x").mapInPandas(run, "cid long, n long")
    for r in rows.groupBy("cid").agg(F.sum("n").alias("n")).collect():  # at most AUDIT_ROWS
        truth[r["cid"]] = r["n"]
    asked = classes.sparkSession.createDataFrame([(c,) for c in truth], "cid long")
    found = {r["cid"]: r["n"] for r in links.join(F.broadcast(asked), "cid").groupBy("cid").agg(F.sum("n").alias("n")).collect()}
    wanted = sum(truth.values())
    return sum(min(n, found.get(c, 0)) for c, n in truth.items()) / wanted if wanted else 1.0


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id,
    embedding): the other rows with a cosine of at least ``least``, the smallest
    vec_id reachable by links, and whether it is the row's own.

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, and so do vectors of different lengths; such a row is its
    own component.  Repeated rows and ids are rows of their own, equal vectors
    link; a row without an id takes part, and a group without any id has no
    component_id (kept is then true).  Other columns are not read.  An empty
    table gives no rows."""
    spark: SparkSession = vectors.sparkSession
    classes = classes_of(vectors)
    shapes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    chord = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    centroids: dict[int, np.ndarray] = {}
    sample = classes.select("dims", "x", F.xxhash64("x").alias("h")).orderBy("h").limit(SAMPLE_ROWS).toPandas()
    for dims, part in sample.groupby("dims"):
        shards = min(MAX_SHARDS, -(-shapes[int(dims)] // SHARD_ROWS), len(part))
        centroids[int(dims)] = fit_centroids(unit(_scaled(_vectors(part["x"]))), shards)
    factor, beam = DEVIATIONS, SEARCH_BEAM
    while True:
        margin = {d: min(chord, factor * chord / math.sqrt(d)) for d in centroids}
        links = search(classes, centroids, margin, least, beam)
        recall = audit_recall(classes, links, least)
        if recall >= LEAST_RECALL or (all(m >= chord for m in margin.values()) and beam >= 16 * SEARCH_BEAM):
            break
        factor, beam = 2 * factor, min(2 * beam, 16 * SEARCH_BEAM)
    groups = components(links.where("root <> cid").select(F.col("cid").alias("x"), F.col("root").alias("y")))
    counted = links.groupBy("cid").agg(F.sum("n").alias("n"))
    placed = (classes.select("cid", "x", "copies", "first").join(counted, "cid", "left")
              .join(groups.select(F.col("sig").alias("cid"), "comp"), "cid", "left")
              .select("x", "first", F.coalesce("comp", "cid").alias("comp"),
                      (F.coalesce("n", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links")))
    heads = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_vector = placed.join(heads, "comp").select("x", "n_links", "component_id", F.lit(True).alias("good"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return (rows.join(by_vector, "x", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                    component.eqNullSafe(F.col("vec_id")).alias("kept")))
