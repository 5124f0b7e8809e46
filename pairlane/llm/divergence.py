"""Divergence between the term distributions of groups of documents.

Documents fall into groups (lang, source).  The kept terms of a language have the
ids 0, 1, ... in the order of their bytes, and a group's counts over these ids are
a segment tree.  Trees are hash-consed: a node is its two children, and equal
subtrees, of one group or of several, are one node.  Two groups are compared by
walking both trees at once; the price of a pair of nodes is remembered, so equal
pairs are priced once however often they occur.

The ids are cut into blocks of ``BLOCK_TERMS``; the subtrees over one block, for
at most two tiles of ``TILE_GROUPS`` groups, are one task's work, and the prices
of blocks are summed by Spark.  So a task is bounded whatever the vocabulary and
the number of groups.  All arithmetic is on integers without bound.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from pairlane.llm.common import stored
from pairlane.plans.indexing import dense_index

#: Terms of a block (a power of two) and groups of a tile.
BLOCK_TERMS, TILE_GROUPS = 1 << 11, 64
#: Distinct (group, term) entries that a task holds before it passes them on.
HELD_TERMS = 400_000
#: Parts of a language's join of groups with blocks.
SALT = 64
#: Probabilities are whole parts of this.
SCALE = 1_000_000_000

#: Fixed rule: letters A-Z in lower case, other ASCII signs separate, the rest stays.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"
PRICED = "lang string, a long, b long, value long, top array<struct<id:long,value:long>>"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it) in partial
    sums, and one row without a term for every group."""
    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush():
            for (lang, source), (times, with_it) in held.items():
                n = len(times) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n),
                    pa.array([None, *times], pa.binary()).cast(pa.string()),
                    pa.array([0, *times.values()], pa.int64()),
                    pa.array([0, *map(with_it.__getitem__, times)], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                if (lang, source) not in held:
                    held[lang, source] = (Counter(), Counter())
                times, with_it = held[lang, source]
                before = len(times)
                own = Counter(text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split())
                times.update(own)
                with_it.update(own.keys())
                size += len(times) - before
                if size > HELD_TERMS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]) \
               .mapInArrow(run, COUNTED)


class Forest:
    """Hash-consed segment trees over the terms of a block.  Node 0 is the place
    beyond the last term; a leaf is a count, an inner node a pair of nodes."""

    def __init__(self, n_terms: int):
        self.n_terms = n_terms
        self.levels = max(0, n_terms - 1).bit_length()
        self.names: dict = {(): 0}
        self.nodes: list = [()]

    def node(self, content) -> int:
        got = self.names.get(content)
        if got is None:
            got = self.names[content] = len(self.nodes)
            self.nodes.append(content)
        return got

    def tree(self, counts: dict[int, int]) -> int:
        """The root of the tree with ``counts`` (place: count; else 0)."""
        row = [self.node(("count", counts.get(k, 0))) for k in range(self.n_terms)]
        row += [0] * ((1 << self.levels) - self.n_terms)
        for level in range(self.levels):
            row = [self.node((level, a, b)) if a or b else 0 for a, b in zip(row[::2], row[1::2])]
        return row[0]


def share(count: int, total: int, terms: int) -> int:
    return 1 + SCALE * (count + 2) // (total + 2 * terms)


class Walk:
    """Prices pairs of nodes over the trees of a forest for a language of ``terms``
    terms; a group is its total and its root."""

    def __init__(self, forest: Forest, terms: int):
        self.forest, self.terms = forest, terms
        inner = [n if len(n) == 3 else (0, 0, 0) for n in forest.nodes]
        self.left = np.array([n[1] for n in inner], np.int64)
        self.right = np.array([n[2] for n in inner], np.int64)
        self.counts = {k: n[1] for k, n in enumerate(forest.nodes) if len(n) == 2}

    def shares(self, total: int) -> np.ndarray:
        """The share of every leaf's count in a group; at most SCALE + 1, so squares
        of differences are 64-bit numbers whatever the counts."""
        out = np.ones(len(self.forest.nodes), np.int64)
        for k, count in self.counts.items():
            if count <= total:  # a leaf of another group may have more than this one has in all
                out[k] = share(count, total, self.terms)
        return out

    def price(self, x: int, y: int, p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
        """(sum of the prices of all terms, leaf pairs priced) of the roots ``x`` and
        ``y`` of groups with the shares ``p`` and ``q``.  Both trees are walked at
        once, level by level; pairs that are equal become one with their number."""
        xs, ys, times = np.array([x]), np.array([y]), np.ones(1, np.int64)
        for _ in range(self.forest.levels):
            xs = np.concatenate([self.left[xs], self.right[xs]])
            ys = np.concatenate([self.left[ys], self.right[ys]])
            pair, of = np.unique(xs * len(self.left) + ys, return_inverse=True)
            times = np.bincount(of, np.concatenate([times, times])).astype(np.int64)
            xs, ys = pair // len(self.left), pair % len(self.left)
            times, xs, ys = times[xs > 0], xs[xs > 0], ys[xs > 0]  # node 0 lies beyond the last term
        d = p[xs] - q[ys]
        return int((times * (d * d // (p[xs] + q[ys]))).sum()), len(xs)

    def top(self, x: int, y: int, p: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (-price, place) of terms with a count in the first tree that are
        likelier there; ties to the smaller place.  Equal pairs are listed once."""
        p, q, known = p.tolist(), q.tolist(), {}

        def best(x, y, half):
            got = known.get((x, y))
            if got is None:
                left = self.forest.nodes[x]
                if not x:
                    got = []
                elif len(left) == 2:
                    d = p[x] - q[y]
                    got = [(-(d * d // (p[x] + q[y])), 0)] if left[1] and d > 0 else []
                else:
                    right = self.forest.nodes[y]
                    got = best(left[1], right[1], half // 2) + \
                        [(v, half + at) for v, at in best(left[2], right[2], half // 2)]
                    if len(got) > 1:
                        got = sorted(got)[:k]
                known[x, y] = got
            return got
        return best(x, y, (1 << self.forest.levels) // 2)


def _price_block(block_terms: int, k: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, block = key[0], int(key[1])
        terms, base = int(pdf["terms"].iloc[0]), block * block_terms
        forest = Forest(min(block_terms, terms - base))
        groups = {}
        for g, tile, total, entries in zip(pdf["g"], pdf["tile"], pdf["total"], pdf["entries"]):
            if int(g) not in groups:
                counts = {int(e["id"]) - base: int(e["n"]) for e in (entries if entries is not None else [])}
                groups[int(g)] = (int(tile), int(total), forest.tree(counts))
        walk, rows, (i, j) = Walk(forest, terms), [], (int(key[2]), int(key[3]))
        shares = {g: walk.shares(total) for g, (_, total, _) in groups.items()}
        for a, (tile_a, _, x) in groups.items():
            for b, (tile_b, _, y) in groups.items():
                if b == -1 and a != -1 and i == j:  # against the whole language
                    best = walk.top(x, y, shares[a], shares[b], k)
                    rows.append((lang, a, b, None, [{"id": base + at, "value": -v} for v, at in best]))
                elif -1 < a < b and (tile_a, tile_b) == (i, j):
                    rows.append((lang, a, b, walk.price(x, y, shares[a], shares[b])[0], None))
        out = pd.DataFrame(rows, columns=["lang", "a", "b", "value", "top"])
        out["value"] = out["value"].astype("Int64")
        return out
    return run


def audit(docs: DataFrame, min_docs: int = 10, k: int = 10,
          block_terms: int = BLOCK_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """lang, source, part, item, value and rank of every group of ``docs`` (lang,
    source, text): part ``pair`` compares it with every other source of its
    language (0 without kept terms), part ``term`` lists the ``k`` terms that set
    it apart from its whole language.

    Null lang, source and text count as empty ones; repeated rows are documents
    of their own; texts without terms still make their group; other columns are
    not read; an empty table gives no rows.  A term is kept where at least
    ``min_docs`` documents of the language have it."""
    partial = stored(term_counts(docs), "terms")
    groups = partial.where("term IS NULL").select("lang", "source").distinct()
    counts = stored(partial.where("term IS NOT NULL").groupBy("lang", "source", "term")
                    .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = (counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "n"))
    placed = dense_index(kept, ["lang", "term"], "place")
    langs = placed.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("terms"),
                                       F.sum("n").alias("lang_total"))
    placed = stored(placed.join(langs, "lang").select("lang", "term", "n", (F.col("place") - F.col("first")).alias("id"),
                                                      "terms"), "vocabulary")
    used = counts.select("lang", "source", "term", "n").join(placed.select("lang", "term", "id"), ["lang", "term"])
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # groups are numbered over all languages; a tile is a stretch of them
    numbered = dense_index(groups.join(totals, ["lang", "source"], "left")
                           .select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total")),
                           ["lang", "source"], "g")
    numbered = stored(numbered.withColumn("tile", F.floor(F.col("g") / tile_groups)), "groups")

    block = F.floor(F.col("id") / block_terms)
    packed = (used.join(numbered.select("lang", "source", "g"), ["lang", "source"])
              .select("lang", "g", block.alias("block"), "id", "n")
              .unionByName(placed.select("lang", F.lit(-1).cast("long").alias("g"), block.alias("block"), "id", "n"))
              .groupBy("lang", "g", "block").agg(F.collect_list(F.struct("id", "n")).alias("entries")))
    blocks = placed.select("lang", block.alias("block")).distinct()
    members = (numbered.select("lang", "g", "tile", "total")
               .unionByName(langs.select("lang", F.lit(-1).cast("long").alias("g"), F.lit(-1).cast("long").alias("tile"),
                                         F.col("lang_total").alias("total"))))
    tiles = numbered.select("lang", "tile").distinct()
    pairs = (tiles.select("lang", F.col("tile").alias("i")).join(tiles.select("lang", F.col("tile").alias("j")), "lang")
             .where("i <= j"))
    # a language may have many groups and blocks, so their join is salted by the block
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    wanted = (members.join(langs.select("lang", "terms"), "lang").join(pairs, "lang")
              .where("tile = i OR tile = j OR (tile = -1 AND i = j)").withColumn("salt", salt))
    dealt = (wanted.join(blocks.withColumn("salt", F.pmod("block", F.lit(SALT)).cast("int")), ["lang", "salt"])
             .join(packed, ["lang", "g", "block"], "left"))
    priced = stored(dealt.select("lang", "block", "i", "j", "g", "tile", "total", "terms", "entries")
                    .groupBy("lang", "block", "i", "j").applyInPandas(_price_block(block_terms, k), PRICED), "prices")

    one = priced.where("b >= 0").groupBy("a", "b").agg(F.sum("value").cast("long").alias("value"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    left = numbered.select("lang", "source", F.col("g").alias("a"))
    right = numbered.select("lang", F.col("source").alias("item"), F.col("g").alias("b"))
    pair = (left.join(right, "lang").where("a <> b").join(both, ["a", "b"], "left")
            .select("lang", "source", F.lit("pair").alias("part"), "item",
                    F.coalesce("value", F.lit(0).cast("long")).alias("value")))
    term = (priced.where("b = -1").select("lang", "a", F.explode("top").alias("t"))
            .select("lang", "a", F.col("t.id").alias("id"), F.col("t.value").cast("long").alias("value"))
            .join(left, ["lang", "a"]).join(placed.select("lang", "id", "term"), ["lang", "id"])
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).cast("int").alias("rank")
    return (pair.select("*", rank).unionByName(term.select("*", rank).where(F.col("rank") <= k))
            .select("lang", "source", "part", "item", "value", "rank"))


_LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
AUDIT_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS} AS t
  FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(t.total, 0)::HUGEINT AS total
      FROM (SELECT DISTINCT lang, source FROM d) d
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + 1000000000 * (coalesce(c.n, 0)::HUGEINT + 2) // (g.total + 2 * v.v) AS p,
             1 + 1000000000 * (k.n::HUGEINT + 2) // (v.total + 2 * v.v) AS q
      FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS sx, y.source AS sy, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.sx = a.source AND s.sy = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value
  FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
