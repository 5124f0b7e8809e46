"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents of one shingle set are one class, and only classes are joined.  All
shingles stand in one order, rare ones first (a counter table of fixed size
estimates how often each occurs; the order only steers cost, any order gives
the same result).  Two sets of Jaccard t share at least ``ceil(t * size)``
shingles, so their prefixes of ``size - ceil(t * size) + l`` shingles share at
least ``l``.  Each class lengthens its prefix to the ``l`` with the least
estimated cost, and a pair becomes a candidate only with ``min(l)`` shared
prefix shingles.  Candidates are verified on their whole sets.

Prefix shingles of many classes (over ``HOT``) would make a pair of everyone
with everyone.  Their classes are compared in tiles of bounded size instead,
each tile a small matrix product over whole sets, and a tile returns links to
the smallest member of each group it finds rather than all pairs.  Groups are
then closed over all links.

Results are exact up to equal 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from pairlane.llm.common import small_batches, stored
from pairlane.llm.shingles import shingle_sets

#: Counters of the frequency estimate: 2**HEAT_BITS, whatever the input.
HEAT_BITS, HEAT_PARTS = 21, 64
#: Longest extra prefix, and the cost of a shipped shingle against a verified pair.
#: (whose two whole sets travel), in prefix shingles; COLD is the expected
#: number of partners of a shingle that the estimate calls rare.
MAX_MATCHES, SHIP_COST, VERIFY_COST, COLD = 8, 1.0, 200.0, 0.2
#: Prefix shingles of more classes than this are joined in tiles.
HOT = 32
#: Shingles (of all members) and members in one side of a tile: its columns and rows.
TILE_SHINGLES, TILE_ROWS = 1 << 17, 2048
#: Bits of the filter that picks the texts whose sets verification needs.
FILTER_BITS = 22


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


# -- frequency estimate -------------------------------------------------------

def heat_table(docs: DataFrame, n: int) -> np.ndarray:
    """Class of each counter: 0 for usual counts, else 1 + log2 of the excess."""
    per = (1 << HEAT_BITS) // HEAT_PARTS

    def count(batches):
        total = np.zeros(1 << HEAT_BITS, np.int32)
        for pdf in batches:
            got = list(shingle_sets(pdf["text"], n))
            if got:
                top = (np.concatenate(got) >> np.uint64(64 - HEAT_BITS)).astype(np.int64)
                place, times = np.unique(top, return_counts=True)
                total[place] += times.astype(np.int32)
        yield pd.DataFrame({"part": range(HEAT_PARTS), "counts": [
            zlib.compress(total[k * per:(k + 1) * per].tobytes(), 1) for k in range(HEAT_PARTS)]})

    def add(key, pdf):
        total = np.zeros(per, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.int32)
        return pd.DataFrame({"part": [int(key[0])], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "part int, counts binary"
    rows = docs.select("text").mapInPandas(count, schema).groupBy("part").applyInPandas(add, schema).collect()
    if not rows:
        return np.zeros(1 << HEAT_BITS, np.uint8)
    counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in sorted(rows, key=lambda r: r["part"])])
    usual = float(np.median(counts))
    excess = counts - usual
    return np.where(excess > 2.5 * np.sqrt(usual) + 2, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint8)


def adaptive_prefix(s: np.ndarray, heat: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(matches, prefix) of a set: the cheapest length for its own estimate."""
    cls = heat[(s >> np.uint64(64 - HEAT_BITS)).astype(np.int64)]
    least = least_overlap(len(s), percent)
    base = len(s) - least
    longest = min(MAX_MATCHES, least)
    order = np.argsort(cls, kind="stable")[:base + longest]
    # expected partners of each prefix shingle; hot ones cost the same in tiles
    # however many matches are asked for
    z = np.where(cls[order] > 0, 2.0 ** (cls[order].astype(float) - 1), COLD)
    pairs = np.cumsum(np.where(z <= HOT, z, 0))
    tiles = np.cumsum(np.where(z > HOT, float(len(s)), 0))
    costs = [SHIP_COST * (base + k) + VERIFY_COST * pairs[base + k - 1] / k + tiles[base + k - 1]
             for k in range(1, longest + 1)]
    best = int(np.argmin(costs)) + 1
    return best, s[order[:base + best]]


# -- verification -------------------------------------------------------------

def tile_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Boolean matrix of the pairs at or above the threshold."""
    both = left + (right or [])
    values = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    _, code = np.unique(code[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    m, width = len(left), 4096
    inter = np.zeros((m, len(right) if right is not None else m), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, z = np.searchsorted(code, [at, at + width])
        bits = np.zeros((len(both), width), np.float32)
        bits[owner[a:z], code[a:z] - at] = 1
        inter += bits[:m] @ (bits[m:] if right is not None else bits).T
    nl = np.array([len(s) for s in left])
    nr = nl if right is None else np.array([len(s) for s in right])
    out = np.empty(inter.shape, bool)
    for k in range(m):  # a row at a time: no wide copies of the matrix
        out[k] = inter[k] >= -(-percent * (nl[k] + nr) // (100 + percent))
    return out


def _stars(names: list[bytes], a: np.ndarray, b: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(smallest member, member) of each group that the pairs connect."""
    rank = np.empty(len(names), np.int64)
    by_name = sorted(range(len(names)), key=names.__getitem__)
    rank[by_name] = np.arange(len(names))
    a, b, label = rank[a], rank[b], np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(names[by_name[label[k]]], names[by_name[k]]) for k in range(len(names)) if label[k] != k]


def _verify_tile(percent: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["sig", "side"]).sort_values(["side", "sig"])
        sets = [np.asarray(s, dtype=np.int64).view(np.uint64) for s in pdf["shingles"]]
        names = [bytes(s) for s in pdf["sig"]]
        m = int((pdf["side"] == 0).sum())
        diagonal = key[1] == key[2]
        links = tile_links(sets[:m], None if diagonal else sets[m:], percent) if m and (diagonal or m < len(sets)) \
            else np.zeros((0, 0), bool)
        a, b = np.nonzero(np.triu(links, 1) if diagonal else links)
        return pd.DataFrame(_stars(names, a, b if diagonal else b + m), columns=["x", "y"])
    return run


# -- connected groups ---------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(sig, comp): the smallest node that each node of ``edges`` (x, y) reaches.
    Every round takes the least label around and then that label's own label;
    each round's table is written, so lineage does not grow."""
    both = stored(edges.select(F.col("x").alias("u"), F.col("y").alias("v"))
                  .unionByName(edges.select(F.col("y").alias("u"), F.col("x").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("lab")), "labels")
    while True:
        around = (both.join(labels.select(F.col("u").alias("v"), "lab"), "v")
                  .unionByName(labels.select(F.col("u").alias("v"), "u", "lab"))
                  .groupBy("u").agg(F.min("lab").alias("lab")))
        jumped = around.join(labels.select(F.col("u").alias("lab"), F.col("lab").alias("next")), "lab")
        new = stored(jumped.select("u", F.col("next").alias("lab")), "labels")
        changed = new.join(labels, ["u", "lab"], "left_anti").limit(1).count()
        labels = new
        if not changed:
            return labels.select(F.col("u").alias("sig"), F.col("lab").alias("comp"))


# -- the join -----------------------------------------------------------------

def prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, sig, n_shingles, matches and prefix of every document; ``pl_key``,
    where it is a column, goes along."""
    spark = docs.sparkSession
    small_batches(spark)
    heat = spark.sparkContext.broadcast(heat_table(docs, n))

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, s in zip(pdf["doc_id"], shingle_sets(pdf["text"], n)):
                need, head = adaptive_prefix(s, heat.value, percent) if len(s) else (0, s)
                rows.append((doc, signature(s), len(s), need, head.view(np.int64)))
            out = pd.DataFrame(rows, columns=["doc_id", "sig", "n_shingles", "matches", "prefix"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            for c in more:
                out[c] = pdf[c].to_numpy()
            yield out

    more = [c for c in docs.columns if c == "pl_key"]
    return docs.select("doc_id", "text", *more).mapInPandas(
        run, "doc_id long, sig binary, n_shingles long, matches int, prefix array<long>"
             + "".join(f", {c} binary" for c in more))


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(sig, shingles) of the classes in ``wanted`` (sig), from the texts again:
    a bit table of fixed size passes few others, and the join drops those."""
    spark = docs.sparkSession
    bit = F.conv(F.hex(F.substring("sig", 1, 3)), 16, 10).cast("long").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (wanted.withColumn("bit", bit)
             .groupBy(F.shiftright("bit", 6).alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("b"))
             .collect())  # at most 2**(FILTER_BITS - 6) rows
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words:
        table[r["w"]] = r["b"]
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        bits, seen = shared.value.view(np.uint64), set()
        for pdf in batches:
            rows = []
            for s in shingle_sets(pdf["text"], n):
                sig = signature(s)
                k = int.from_bytes(sig[:3], "big") & ((1 << FILTER_BITS) - 1)
                if (int(bits[k >> 6]) >> (k & 63)) & 1 and sig not in seen:
                    seen.add(sig)
                    rows.append((sig, s.view(np.int64)))
            yield pd.DataFrame(rows, columns=["sig", "shingles"])

    got = docs.select("text").mapInPandas(run, "sig binary, shingles array<long>")
    return got.join(wanted.distinct(), "sig", "left_semi").dropDuplicates(["sig"])


def in_blocks(hot: DataFrame) -> DataFrame:
    """``hot`` (token, sig, n_shingles) with ``block``, the members of a token in
    order of size.  A member counts as its shingles, or as its part of the rows
    of a tile where that is more, so a block is bounded in both."""
    share = F.greatest(F.col("n_shingles").cast("long"), F.lit(-(-TILE_SHINGLES // TILE_ROWS)))
    before = F.sum(share).over(W.partitionBy("token").orderBy("n_shingles", "sig")
                               .rowsBetween(W.unboundedPreceding, -1))
    return hot.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / TILE_SHINGLES).cast("int"))


def links(docs: DataFrame, found: DataFrame, n: int, percent: int) -> DataFrame:
    """(x, y) pairs of classes whose closure is the closure of all links."""
    classes = found.where("n_shingles > 0").dropDuplicates(["sig"])
    entry = classes.select("sig", "n_shingles", "matches", F.explode("prefix").alias("token"))
    entry = stored(entry.withColumn("classes", F.count("*").over(W.partitionBy("token")))
                   .where("classes > 1"), "entries")

    rare = entry.where(F.col("classes") <= HOT)
    a, b = rare.alias("a"), rare.alias("b")
    pairs = (a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.sig") < F.col("b.sig"))
                    & (100 * F.least("a.n_shingles", "b.n_shingles") >= percent * F.greatest("a.n_shingles", "b.n_shingles")))
             .groupBy(F.col("a.sig").alias("x"), F.col("b.sig").alias("y"))
             .agg(F.count("*").alias("shared"), F.first(F.least("a.matches", "b.matches")).alias("need")))
    pairs = stored(pairs.where("shared >= need").select("x", "y"), "pairs")

    hot = entry.where(F.col("classes") > HOT).select("token", "sig", "n_shingles")
    hot = stored(in_blocks(hot), "hot")
    ranges = hot.groupBy("token", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    p, q = ranges.alias("p"), ranges.alias("q")
    tiles = (p.join(q, (F.col("p.token") == F.col("q.token")) & (F.col("p.block") <= F.col("q.block"))
                    & (percent * F.col("q.low") <= 100 * F.col("p.high")))
             .select(F.col("p.token").alias("token"), F.col("p.block").alias("i"), F.col("q.block").alias("j")))
    member = hot.select("token", "block", "sig")
    dealt = (member.join(tiles.withColumn("block", F.col("i")), ["token", "block"]).withColumn("side", F.lit(0))
             .unionByName(member.join(tiles.where("i < j").withColumn("block", F.col("j")), ["token", "block"])
                          .withColumn("side", F.lit(1)))).select("token", "i", "j", "side", "sig")

    wanted = pairs.select(F.col("x").alias("sig")).unionByName(pairs.select(F.col("y").alias("sig"))) \
                  .unionByName(hot.select("sig")).distinct()
    sets = stored(_sets_of(docs, stored(wanted, "wanted"), n), "sets")

    left = sets.select(F.col("sig").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("sig").alias("y"), F.col("shingles").alias("sy"))
    inter = F.size(F.array_intersect("sx", "sy"))
    checked = (pairs.join(left, "x").join(right, "y")
               .where(100 * inter >= percent * (F.size("sx") + F.size("sy") - inter)).select("x", "y"))
    tiled = (dealt.join(sets, "sig").groupBy("token", "i", "j")
             .applyInPandas(_verify_tile(percent), "x binary, y binary"))
    return checked.unionByName(tiled)


def _groups(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``prefixes`` of ``docs``, written, and (sig, first, comp) of every class with
    words: its smallest doc_id and its group."""
    found = stored(prefixes(docs, n, percent), "prefixes")
    comp = components(links(docs, found, n, percent))
    own = found.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("first"))
    return found, own.join(comp, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))


def near_duplicates(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (``doc_id``,
    ``text``): the smallest doc_id reachable by links.  Texts without words link
    with nothing; a group without any doc_id has none; repeated rows are copies."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, placed = _groups(docs, n, percent)
    rows = found.select("doc_id", "sig", "n_shingles")
    heads = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_sig = placed.join(heads, "comp").select("sig", "component_id")
    return (rows.join(by_sig, "sig", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group: one of the smallest doc_id in it, with all its columns.
    Rows of one id whose texts do not link are in different groups, and each group
    keeps its own; of the rows of one id without words one stays.  Rows without
    an id cannot be told apart and stay."""
    key = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found, placed = _groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                        F.col("text").cast("string").alias("text"), key.alias("pl_key")), n, percent)
    rows = found.where("doc_id IS NOT NULL").select("doc_id", "sig", "n_shingles", "pl_key")
    # a class has one row here, so that a copied text is no hot key of the join
    least = F.min(F.struct("doc_id", "pl_key")).alias("head")
    worded = (rows.where("n_shingles > 0").groupBy("sig").agg(least)
              .join(placed.select("sig", "comp"), "sig").groupBy("comp").agg(F.min("head").alias("head")))
    bare = rows.where("n_shingles = 0").groupBy("doc_id").agg(least)
    heads = (worded.select("head").unionByName(bare.select("head"))
             .select(F.col("head.doc_id").alias("pl_id"), F.col("head.pl_key").alias("pl_key")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("pl_row"),
                         F.col("doc_id").cast("long").alias("pl_id"), key.alias("pl_key"))
    first = W.partitionBy("pl_id", "pl_key").orderBy(F.xxhash64("pl_row"))
    kept = (packed.where("pl_id IS NOT NULL").join(heads, ["pl_id", "pl_key"], "left_semi")
            .withColumn("pl_n", F.row_number().over(first)).where("pl_n = 1"))
    return kept.select("pl_row.*").unionByName(packed.where("pl_id IS NULL").select("pl_row.*"))
