"""Exact ranks and top-k of sparse queries by maximal contributions.

For every term the index knows its document frequency and the largest weight it
has in any document, so ``query weight * largest weight`` bounds what the term
adds to any score.  Given the score to beat, a query's terms are put aside, the
costliest for their bound first, as long as their bounds together stay below
it: a document that shares only those cannot reach the score.  Only the other
terms of a query (the *essential* ones) lead to documents.

Documents stand in the order of their heaviest terms, so that like ones are
neighbours, and lie in blocks of ``BLOCK_DOCS``; a query goes to the blocks that
hold one of its essential terms.  There a block knows the largest weight of every
term in each stripe of ``STRIPE`` documents and in each group of stripes, and only
documents of groups, then stripes, whose bounds together reach the score are scored.
Blocks return counts (ranks) or at most k rows a query (top-k); no table of all
query-document pairs exists at any stage, and one path serves all sizes.

The score to beat is the positive's for a rank.  For a top-k it is first the
largest ``query weight * k-th largest document weight`` of a term, a score that
k documents reach; each query is then answered in the block of its best term's
best document, and the k-th score found there is beaten in the others.

A block and a chunk of its queries are one task's input, bounded by ``BLOCK_DOCS``
and (on average) ``QUERY_ROWS`` vectors.  Vectors are checkpointed, which ends their
lineage: kept tables that read kept tables would otherwise repeat each other's plans
in every plan that Spark reports to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from pairlane.operators.ranking import SCORE_DIGITS
from pairlane.plans.indexing import dense_index
from pairlane.session import materialize, reuse

BLOCK_DOCS, QUERY_ROWS = 32_768, 65_536
#: Queries of a chunk, at least, where blocks are fewer than tasks of the cluster.
LEAST_ROWS, TASKS_A_CORE = 1024, 4
#: Documents of a stripe, at least, numbers in a block's table of stripes, at most, and
#: stripes of a group.
STRIPE, STRIPE_CELLS, GROUP = 8, 1 << 23, 16
#: So many terms of a block, at most, are columns: those in one of ``COLUMN_SHARE`` documents.
COLUMNS, COLUMN_SHARE = 256, 16
#: Up to so many documents are scored along their own terms.
FEW = 1024
#: Up to so many rows a table with a row for each term (or term and block) is broadcast.
BROADCAST_ROWS = 500_000
#: Heaviest terms that the order of documents goes by.
ORDER_TERMS = 8
#: Bounds are compared with this slack, above any rounding of sums and scores.
SLACK = 1e-8
#: A top-k keeps so many largest weights of a term beyond k, for exclusions.
SPARE = 24

COUNTS = "query_id long, n_gt long, n_tie long, n_gt_before long"
FOUND = "query_id long, corpus_idx long, score double"


class Block:
    """Postings of the documents of a block, in their order (``place``, or
    ``corpus_idx`` where there is none); documents without terms have none."""

    def __init__(self, docs: pd.DataFrame):
        docs = docs.sort_values("place" if "place" in docs.columns else "corpus_idx")
        lens = np.fromiter(map(len, docs["term_ids"]), np.int64, len(docs))
        self.idx, lens = docs["corpus_idx"].to_numpy(np.int64)[lens > 0], lens[lens > 0]
        terms = np.concatenate([np.asarray(a, np.int64) for a in docs["term_ids"]] or [np.zeros(0, np.int64)])
        weights = np.concatenate([np.asarray(a, np.float64) for a in docs["weights"]] or [np.zeros(0)])
        order = np.argsort(terms, kind="stable")
        self.doc, self.weight = np.repeat(np.arange(len(lens)), lens)[order], weights[order]
        self.terms, first, self.df = np.unique(terms[order], return_index=True, return_counts=True)
        self.first, self.stop = first.tolist(), (first + self.df).tolist()
        self.largest = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        frequent = np.argsort(-self.df, kind="stable")[:COLUMNS]
        self.columns = dict.fromkeys(frequent[COLUMN_SHARE * self.df[frequent] >= len(lens)].tolist())
        # the same by documents, and the largest weights of every stripe and group of stripes
        self.row = np.append(0, np.cumsum(lens))
        self.row_code, self.row_weight = np.empty(len(terms), np.int64), weights
        self.row_code[order] = np.repeat(np.arange(len(first)), self.df)
        self.given, self.total = np.zeros(len(first)), np.zeros(len(lens))
        stripes = max(1, min(-(-len(lens) // STRIPE), STRIPE_CELLS // max(1, len(first))))
        self.stripe = max(1, -(-len(lens) // stripes))
        groups = -(-len(lens) // (self.stripe * GROUP))
        self.most = np.zeros((len(first), groups * GROUP))
        if len(terms):
            key = self.row_code[order] * self.most.shape[1] + self.doc // self.stripe
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            self.most.reshape(-1)[key[start]] = np.maximum.reduceat(self.weight, start)
        self.most_group = self.most.reshape(len(first), groups, GROUP).max(axis=2, initial=0)

    def own_terms(self, term_ids, weights):
        """(places of the terms, weights) of each vector, without terms that the
        block does not have."""
        if not len(self.terms):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(term_ids)
        lens = np.fromiter(map(len, term_ids), np.int64, len(term_ids))
        ids = np.concatenate([np.asarray(a, np.int64) for a in term_ids] or [np.zeros(0, np.int64)])
        w = np.concatenate([np.asarray(a, np.float64) for a in weights] or [np.zeros(0)])
        t = np.minimum(np.searchsorted(self.terms, ids), len(self.terms) - 1)
        here = self.terms[t] == ids
        stop = np.append(0, np.cumsum(here))[np.cumsum(lens)].tolist()
        t, w = t[here], w[here]
        return [(t[a:z], w[a:z]) for a, z in zip([0] + stop[:-1], stop)]

    def scores(self, t: np.ndarray, w: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of the documents at the places ``docs``."""
        if len(docs) <= FEW:  # along the documents
            if not len(docs):
                return np.zeros(0)
            first, lens = self.row[docs], self.row[docs + 1] - self.row[docs]
            start = np.cumsum(lens) - lens
            at = np.repeat(first - start, lens) + np.arange(start[-1] + lens[-1])
            self.given[t] = w
            products = self.given[self.row_code[at]] * self.row_weight[at]
            self.given[t] = 0.0
            return np.add.reduceat(products, start)
        often = [(i, x) for i, x in zip(t.tolist(), w.tolist()) if i in self.columns]
        spans = [(self.first[i], self.stop[i], x) for i, x in zip(t.tolist(), w.tolist()) if i not in self.columns]
        for a, z, x in spans:
            self.total[self.doc[a:z]] += self.weight[a:z] * x
        score = self.total[docs]
        for a, z, _ in spans:
            self.total[self.doc[a:z]] = 0.0
        for i, x in often:
            if self.columns[i] is None:
                column = self.columns[i] = np.zeros(len(self.idx))
                column[self.doc[self.first[i]:self.stop[i]]] = self.weight[self.first[i]:self.stop[i]]
            score += x * self.columns[i][docs]
        return score

    def within(self, stripes: np.ndarray, size: int) -> np.ndarray:
        """Places in ``stripes`` of ``size`` documents."""
        docs = (stripes[:, None] * size + np.arange(size)).ravel()
        return docs[docs < len(self.idx)]

    def reach(self, term_ids, weights, beat: float, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(places, rounded scores) of every document with a score over 0 that may
        reach ``beat``; with ``k``, of every one that may be among the k best."""
        return self.reached(*self.own_terms([term_ids], [weights])[0], beat, k)

    def reached(self, t: np.ndarray, w: np.ndarray, beat: float, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """``reach`` for ``own_terms``."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(t):
            return none
        upper = w @ self.most_group[t]
        if k:  # k documents of the best groups have at least the k-th score there
            size = self.stripe * GROUP
            some = min(len(upper), -(-2 * k // size) + 1)
            score = self.scores(t, w, self.within(np.argpartition(-upper, some - 1)[:some], size))
            if len(score) >= k:
                beat = max(beat, float(np.partition(score, len(score) - k)[len(score) - k]))
        pick = np.flatnonzero(upper >= beat - SLACK)
        if not len(pick):
            return none
        pick = (pick[:, None] * GROUP + np.arange(GROUP)).ravel()
        upper = w @ (self.most[t] if len(pick) == self.most.shape[1] else self.most[t[:, None], pick])
        docs = self.within(pick[upper >= beat - SLACK], self.stripe)
        score = self.scores(t, w, docs)
        keep = (score > 0) & (score >= beat - SLACK)
        return docs[keep], np.round(score[keep], SCORE_DIGITS)


def _count_cell(key, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(q) and len(d):
        block = Block(d)
        for qid, pos, s_pos, own in zip(q["query_id"], q["pos_idx"], q["s_pos"], block.own_terms(q["term_ids"], q["weights"])):
            docs, score = block.reached(*own, s_pos)
            if not len(docs):
                continue
            idx, s = block.idx[docs], np.round(s_pos, SCORE_DIGITS)
            above = (score > s) & (idx != pos)
            rows.append((qid, int(above.sum()), int(((score == s) & (idx < pos)).sum()), int((above & (idx < pos)).sum())))
    return pd.DataFrame(rows, columns=["query_id", "n_gt", "n_tie", "n_gt_before"])


def _best_cell(k: int):
    def run(key, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(d):
            block = Block(d)
            own = block.own_terms(q["term_ids"], q["weights"])
            for qid, beat, (t, w), gone in zip(q["query_id"], q["beat"], own, q["excluded"]):
                gone = () if gone is None else gone
                docs, score = block.reached(t, w, beat, k + len(gone))
                keep = score > 0
                if len(gone):
                    keep &= ~np.isin(block.idx[docs], gone)
                docs, score = docs[keep], score[keep]
                best = np.lexsort((block.idx[docs], -score))[:k]
                out.append((np.full(len(best), qid), block.idx[docs[best]], score[best]))
        parts = [np.concatenate(p) for p in zip(*out)] if out else [np.zeros(0)] * 3
        return pd.DataFrame(dict(zip(["query_id", "corpus_idx", "score"], parts)))
    return run


# -- the index and the routes ---------------------------------------------------

def packed(v: DataFrame, id_col: str) -> DataFrame:
    """One row per vector: ``term_ids`` ascending and their ``weights``."""
    e = F.sort_array(F.collect_list(F.struct("term_id", "w")))
    return (v.groupBy(id_col).agg(e.alias("e"))
            .select(id_col, F.col("e.term_id").cast("array<long>").alias("term_ids"), F.col("e.w").alias("weights")))


def entries(vectors: DataFrame, *keep: str) -> DataFrame:
    """``packed`` again as rows of ``keep``, term_id and w."""
    e = F.explode(F.arrays_zip("term_ids", "weights")).alias("e")
    return vectors.select(*keep, e).select(*keep, F.col("e.term_ids").alias("term_id"), F.col("e.weights").alias("w"))


def in_blocks(dv: DataFrame) -> DataFrame:
    """The documents' vectors, ``packed``, with ``place`` and ``block``."""
    heavy = F.transform(F.slice(F.sort_array(F.arrays_zip("weights", "term_ids"), False), 1, ORDER_TERMS),
                        lambda e: e["term_ids"])
    docs = dense_index(packed(dv, "corpus_idx"), [heavy, F.col("corpus_idx")], "place")
    return docs.withColumn("block", F.floor(F.col("place") / BLOCK_DOCS))


def term_bounds(docs: DataFrame) -> DataFrame:
    """term_id, df, largest weight and the block of the document that has it."""
    return entries(docs, "block").groupBy("term_id").agg(
        F.count(F.lit(1)).alias("df"), F.max("w").alias("largest"), (-F.max(F.struct("w", -F.col("block")))["col2"]).alias("b"))


def _spread(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def essential_terms(qv: DataFrame, bounds: DataFrame, beat: DataFrame) -> DataFrame:
    """(query_id, term_id) of the terms that lead to documents, given
    ``beat`` (query_id, beat): the costliest for their bound are put aside while
    their bounds stay below the score to beat."""
    t = (qv.join(_spread(bounds.select("term_id", "df", "largest"), bounds.count()), "term_id").join(beat, "query_id")
         .withColumn("bound", F.col("w") * F.col("largest")))
    order = W.partitionBy("query_id").orderBy((F.col("df") / F.greatest("bound", F.lit(1e-300))).desc(), "term_id")
    upto = F.sum("bound").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return t.withColumn("upto", upto).where(F.col("upto") >= F.col("beat") - SLACK).select("query_id", "term_id")


def routes(essential: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, block): the blocks with a document that has an essential term."""
    where = reuse(entries(docs, "block").select("term_id", "block").distinct())
    n = where.count()
    if n <= BROADCAST_ROWS:  # a row a term, so that queries do not grow before they are made distinct
        blocks = where.groupBy("term_id").agg(F.collect_list("block").alias("blocks"))
        where = F.broadcast(blocks)
        return (essential.join(where, "term_id").groupBy("query_id")
                .agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
                .select("query_id", F.explode("blocks").alias("block")))
    return essential.join(where, "term_id").select("query_id", "block").distinct()


def _meet(asked: DataFrame, queries: DataFrame, docs: DataFrame, cell, schema: str) -> DataFrame:
    """``asked`` (query_id, block and what else the cell needs) with the rows of
    ``queries``, against the documents of their blocks.  The queries of a block are
    dealt into chunks by their own number, so its documents go to no more tasks
    than its queries fill (few blocks are cut further, to occupy the cluster)."""
    asked = reuse(asked)
    n = F.count(F.lit(1))
    sizes = reuse(asked.groupBy("block").agg(n.alias("n")))
    tasks = -(-TASKS_A_CORE * asked.sparkSession.sparkContext.defaultParallelism // max(1, sizes.count()))
    chunks = F.greatest(F.ceil(F.col("n") / QUERY_ROWS), F.least(F.lit(tasks), F.ceil(F.col("n") / LEAST_ROWS)))
    sizes = F.broadcast(sizes.select("block", chunks.cast("long").alias("chunks")))  # a row a block
    q = (asked.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks"))).drop("chunks")
         .join(queries, "query_id"))
    d = (docs.join(sizes, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
         .drop("chunks"))
    q = q.select(*[F.col(c).alias(c) for c in q.columns])
    return q.groupBy("block", "chunk").cogroup(d.groupBy("block", "chunk")).applyInPandas(cell, schema)


def positive_scores(queries: DataFrame, docs: DataFrame, positives: DataFrame) -> DataFrame:
    """query_id, pos_idx and s_pos, the (unrounded) score of the positive; both
    tables are ``packed``."""
    own = docs.select(F.col("corpus_idx").alias("pos_idx"), F.map_from_arrays("term_ids", "weights").alias("own"))
    s = F.aggregate(F.arrays_zip("term_ids", "weights"), F.lit(0.0),
                    lambda s, e: s + e["weights"] * F.coalesce(F.try_element_at("own", e["term_ids"]), F.lit(0.0)))
    return (positives.join(own, "pos_idx", "left").join(queries.select("query_id", "term_ids", "weights"), "query_id", "left")
            .select("query_id", "pos_idx", F.coalesce(s, F.lit(0.0)).alias("s_pos")))


def bounded_rank(qv: DataFrame, dv: DataFrame, positives: DataFrame, n_queries: int) -> DataFrame:
    """(query_id, rank): the place of ``positives`` (query_id, pos_idx) among all
    documents by (score desc, corpus_idx).  A positive that shares no term has the
    score 0 and comes after every document with a score, then by index."""
    q, docs = materialize(packed(qv, "query_id")), in_blocks(dv)
    spos = materialize(positive_scores(q, docs, positives))
    ess = essential_terms(entries(q, "query_id"), reuse(term_bounds(docs)), spos.select("query_id", F.col("s_pos").alias("beat")))
    counts = _meet(routes(ess, docs), q.join(spos, "query_id"), docs, _count_cell, COUNTS)
    total = counts.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("n_gt", "n_tie", "n_gt_before")])
    r = spos.join(total, "query_id", "left").fillna(0, ["n_gt", "n_tie", "n_gt_before"])
    tied = F.when(F.round("s_pos", SCORE_DIGITS) == 0, F.col("pos_idx") - F.col("n_gt_before")).otherwise(F.col("n_tie"))
    return r.select("query_id", (1 + F.col("n_gt") + tied).cast("bigint").alias("rank"))


def bounded_topk(qv: DataFrame, dv: DataFrame, query_ids: DataFrame, k: int, n_queries: int, n_corpus: int,
                 exclude: DataFrame | None = None) -> DataFrame:
    """(query_id, corpus_idx, score, rank): the k best documents of every query of
    ``query_ids`` by (score desc, corpus_idx), documents without a shared term
    with score 0 by index.  Pairs of ``exclude`` (query_id, corpus_idx) never
    come; fewer than k rows come only where fewer documents are left."""
    q, d = materialize(packed(qv, "query_id")), in_blocks(dv)
    qv, bounds = entries(q, "query_id"), reuse(term_bounds(d))
    heavy = W.partitionBy("term_id").orderBy(F.col("w").desc())
    kth = (entries(d).withColumn("r", F.row_number().over(heavy)).where(F.col("r") <= k + SPARE)
           .groupBy("term_id").agg(F.sort_array(F.collect_list("w"), False).alias("tops")))  # at most k + SPARE
    gone = None
    need = F.lit(k)
    terms = qv.join(_spread(bounds, bounds.count()), "term_id").join(kth, "term_id")
    if exclude is not None:
        exclude = materialize(exclude.distinct())
        terms = terms.join(exclude.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left")
        need = F.lit(k) + F.coalesce("m", F.lit(0))
        gone = (exclude.join(d.select("corpus_idx", "block"), "corpus_idx").groupBy("query_id", "block")  # at most BLOCK_DOCS
                .agg(F.collect_list("corpus_idx").alias("excluded")))
    least = F.coalesce(F.try_element_at("tops", need.cast("int")), F.lit(0.0)) * F.col("w")
    start = materialize(terms.groupBy("query_id").agg(
        F.max(least).alias("beat"), F.max(F.struct(F.col("w") * F.col("largest"), F.col("b")))["b"].alias("block")))

    def best(asked):
        asked = asked.join(gone, ["query_id", "block"], "left") if gone is not None else \
            asked.withColumn("excluded", F.lit(None).cast("array<long>"))
        return _meet(asked, q, d, _best_cell(k), FOUND)

    first = materialize(best(start.select("query_id", "block", "beat")))
    by_score = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("corpus_idx").asc())
    kth_score = (first.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k)
                 .select("query_id", F.col("score").alias("s")))
    beat = (start.join(kth_score, "query_id", "left")
            .select("query_id", F.greatest("beat", F.coalesce("s", F.lit(0.0))).alias("beat")))
    ess = essential_terms(qv, bounds, beat)
    others = routes(ess, d).join(start.select("query_id", "block"), ["query_id", "block"], "left_anti")
    found = first.unionByName(best(others.join(beat, "query_id")))
    found = materialize(found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k))
    return found.unionByName(_zero_rows(found, query_ids, k, n_corpus, exclude))


def _zero_rows(found: DataFrame, query_ids: DataFrame, k: int, n_corpus: int, exclude: DataFrame | None) -> DataFrame:
    """The missing rows of queries with fewer than k: the first documents by index
    that are neither found nor excluded, with score 0."""
    have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = (query_ids.select("query_id").distinct().join(have, "query_id", "left")
             .select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k))
    if exclude is not None:
        short = (short.join(exclude.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left")
                 .select("query_id", "n", F.coalesce("m", F.lit(0)).alias("m")))
    else:
        short = short.withColumn("m", F.lit(0))
    # among the first k + (taken) indices at least k - n are free, or the corpus ends
    upto = F.least(F.lit(n_corpus), F.lit(k) + F.col("m")).cast("long")
    free = (short.where(upto > 0)
            .select("query_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), upto - 1)).alias("corpus_idx"))
            .join(found.select("query_id", "corpus_idx"), ["query_id", "corpus_idx"], "left_anti"))
    if exclude is not None:
        free = free.join(exclude.select("query_id", "corpus_idx"), ["query_id", "corpus_idx"], "left_anti")
    rank = F.col("n") + F.row_number().over(W.partitionBy("query_id").orderBy("corpus_idx"))
    return (free.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
            .select("query_id", "corpus_idx", F.lit(0.0).alias("score"), "rank"))
