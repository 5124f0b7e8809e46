"""Exact-size stratified sampling, holdouts and low-resource splits.

Sizes follow the stratified-split rule: draw ``n = ceil(f * N)`` rows; each
class gets ``floor(n * N_c / N)``; the rows still missing go to the classes
with the largest fractional parts (equal parts: lower class value first).
Which rows are drawn is fixed by a seeded hash order ``md5(seed|salt|key)``
so every engine draws the same rows.

The rank of a row inside its class is computed without a per-class window
(a class can hold most of the data): rows are range-sorted by (group,
class, hash), numbered densely across the cluster, and the class start
offsets come from the small per-class count table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from pairlane.plans.indexing import dense_index
from pairlane.schema import DEFAULT_SEED


def seeded_hash(seed: int, salt: str, key: str) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}|{salt}|"), F.col(key).cast("string")))


def class_quotas(df: DataFrame, fraction: float, col: str = "label",
                 groups: list[str] | None = None) -> DataFrame:
    """(groups..., col, n_c, quota).  One row per (group, class): small."""
    g = list(groups or [])
    cls = df.groupBy(*g, col).agg(F.count(F.lit(1)).alias("n_c"))
    wg = W.partitionBy(*g) if g else W.partitionBy(F.lit(1))
    tot = F.sum("n_c").over(wg)
    n_draw = F.ceil(F.lit(float(fraction)) * tot)
    q = (cls.withColumn("_n", tot).withColumn("_draw", n_draw)
         .withColumn("_cont", F.col("n_c") / F.col("_n") * F.col("_draw"))
         .withColumn("_fl", F.floor("_cont")))
    q = (q.withColumn("_need", F.col("_draw") - F.sum("_fl").over(wg))
         .withColumn("_rr", F.row_number().over(
             wg.orderBy((F.col("_cont") - F.col("_fl")).desc(), F.col(col).asc()))))
    return q.select(*g, col, "n_c", (F.col("_fl") + F.when(F.col("_rr") <= F.col("_need"), 1)
                                     .otherwise(0)).cast("bigint").alias("quota"))


MAX_LITERAL_STRATA = 64  # map literals are searched linearly; above this, join


def _stratum_key(cols: list[str]) -> F.Column:
    return F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))


def _quotas_py(counts: list[tuple], fraction: float) -> dict:
    """counts: [(group_key, class_value, n_c)] -> {(group_key, class): quota}
    by the same rule as ``class_quotas``."""
    import math
    by_g: dict = {}
    for g, c, n in counts:
        by_g.setdefault(g, []).append((c, n))
    out = {}
    for g, rows in by_g.items():
        n_tot = sum(n for _, n in rows)
        n_draw = math.ceil(float(fraction) * n_tot)
        cont = [(c, n / n_tot * n_draw) for c, n in rows]
        fl = {c: math.floor(v) for c, v in cont}
        need = n_draw - sum(fl.values())
        order = sorted(cont, key=lambda cv: (-(cv[1] - math.floor(cv[1])), cv[0] is not None, cv[0]))
        for i, (c, _) in enumerate(order):
            out[(g, c)] = fl[c] + (1 if i < need else 0)
    return out


def rank_in_class(df: DataFrame, seed: int, salt: str, key: str = "pair_id",
                  col: str = "label", groups: list[str] | None = None,
                  fractions: dict | None = None):
    """Adds ``_rk`` = 1-based position of the row inside its (group, class)
    in seeded hash order.  With ``fractions`` ({name: f}) also adds one
    boolean column per fraction (row is inside that exact stratified
    sample).

    The per-stratum counts (one row per (group, class)) are collected once;
    class start offsets and quotas are applied as literal map lookups.  With
    more strata than MAX_LITERAL_STRATA both are joined instead."""
    g = list(groups or [])
    sk = _stratum_key([*g, col])
    counts = df.groupBy(sk.alias("_sk"), *g, col).agg(F.count(F.lit(1)).alias("n_c"))
    h = df.withColumn("_h", seeded_hash(seed, salt, key))
    idx = dense_index(h, [*g, col, "_h", key], "_gidx")
    rows = counts.limit(MAX_LITERAL_STRATA + 1).collect()
    if len(rows) <= MAX_LITERAL_STRATA:
        # strata in sort order of (groups..., class): start = rows before it
        rows.sort(key=lambda r: tuple((r[c] is not None, r[c]) for c in [*g, col]))
        starts, acc = {}, 0
        for r in rows:
            starts[r["_sk"]] = acc
            acc += r["n_c"]
        lit_map = F.create_map(*[x for k, v in starts.items() for x in (F.lit(k), F.lit(v))])
        out = idx.withColumn("_rk", F.col("_gidx") - F.element_at(lit_map, sk) + 1)
        for name, frac in (fractions or {}).items():
            if frac >= 1.0:
                out = out.withColumn(name, F.lit(True))
                continue
            gkey = [tuple(r[c] for c in g) for r in rows]
            q = _quotas_py([(gk, r[col], r["n_c"]) for gk, r in zip(gkey, rows)], frac)
            qmap = {r["_sk"]: q[(gk, r[col])] for gk, r in zip(gkey, rows)}
            m = F.create_map(*[x for k, v in qmap.items() for x in (F.lit(k), F.lit(v))])
            out = out.withColumn(name, F.col("_rk") <= F.element_at(m, sk))
        return out.drop("_gidx", "_h")
    # the stratum key is a string that is never NULL, so NULL strata join too
    idx = idx.withColumn("_sk", sk)
    starts = idx.groupBy("_sk").agg(F.min("_gidx").alias("_start"))
    out = (idx.join(starts, "_sk")
           .withColumn("_rk", F.col("_gidx") - F.col("_start") + 1).drop("_gidx", "_start", "_h"))
    for name, frac in (fractions or {}).items():
        if frac >= 1.0:
            out = out.withColumn(name, F.lit(True))
            continue
        q = class_quotas(df, frac, col, g).select(sk.alias("_sk"), F.col("quota").alias(f"_q_{name}"))
        out = out.join(q, "_sk").withColumn(name, F.col("_rk") <= F.col(f"_q_{name}")).drop(f"_q_{name}")
    return out.drop("_sk")


def tag_fraction(df: DataFrame, fraction: float, seed: int, salt: str, key: str = "pair_id",
                 col: str = "label", groups: list[str] | None = None) -> DataFrame:
    """Adds boolean ``_in`` = row belongs to the exact stratified sample."""
    return rank_in_class(df, seed, salt, key, col, groups, {"_in": fraction})


def stratified_sample(df: DataFrame, fraction: float, seed: int = DEFAULT_SEED,
                      col: str = "label", key: str = "pair_id", salt: str = "sample",
                      groups: list[str] | None = None) -> DataFrame:
    if fraction >= 1.0:
        return df
    cols = df.columns
    return tag_fraction(df, fraction, seed, salt, key, col, groups).filter("_in").select(*cols)


def holdout_carve(df: DataFrame, fraction: float = 0.10, seed: int = DEFAULT_SEED,
                  col: str = "label", key: str = "pair_id", salt: str = "test",
                  groups: list[str] | None = None, names=("train", "test")) -> DataFrame:
    """One pass: every row tagged ``split`` = test (in the stratified
    holdout) or train."""
    cols = df.columns
    t = tag_fraction(df, fraction, seed, salt, key, col, groups)
    return t.select(*cols, F.when(F.col("_in"), F.lit(names[1])).otherwise(F.lit(names[0])).alias("split"))


def holdout_reuse(train: DataFrame, test: DataFrame, key: str = "pair_id") -> DataFrame:
    """An existing holdout is kept; its keys are removed from train."""
    return train.join(test.select(key).distinct(), key, "left_anti")


def derive_validation(train: DataFrame, fraction: float = 0.10, seed: int = 42,
                      col: str = "label", key: str = "pair_id",
                      groups: list[str] | None = None) -> DataFrame:
    return holdout_carve(train, fraction, seed, col, key, "val", groups, ("train", "validation"))


def low_resource_splits(train: DataFrame, val: DataFrame, test: DataFrame | None,
                        fractions: dict[str, float], seed: int = DEFAULT_SEED,
                        col: str = "label", key: str = "pair_id",
                        groups: list[str] | None = None) -> DataFrame:
    """Union of tagged splits: train_<name> for each fraction (nested: the
    smaller sample is a prefix of the larger in hash order), val, test.
    An empty/absent test is carved (10 %) from train first; otherwise its
    keys are removed from train.  Val and test are never subsampled."""
    cols = train.columns
    if test is None:
        carved = holdout_carve(train, 0.10, seed, col, key, "test", groups)
        test = carved.filter(F.col("split") == "test").select(*cols)
        train = carved.filter(F.col("split") == "train").select(*cols)
    else:
        train = holdout_reuse(train, test, key)
    flags = {f"_in_{name}": frac for name, frac in fractions.items()}
    ranked = rank_in_class(train, seed, "train", key, col, groups, flags)
    out = []
    for name in fractions:
        out.append(ranked.filter(F.col(f"_in_{name}"))
                   .select(*cols, F.lit(f"train_{name}").alias("split")))
    out.append(val.select(*cols, F.lit("val").alias("split")))
    out.append(test.select(*cols, F.lit("test").alias("split")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def split_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts per split: pairs, match, non-match, hard negatives, match
    fraction (4 places)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("label") == 1).alias("n_match"),
        F.count_if(F.col("label") == 0).alias("n_non_match"),
        F.count_if(F.col("is_hard_negative") == True).alias("n_hard_neg"),  # noqa: E712
        F.round(F.avg((F.col("label") == 1).cast("double")), 4).alias("match_fraction"))


def split_stats_rollup(df: DataFrame, by: list[str]) -> DataFrame:
    """Totals over every prefix of ``by`` (NULL = all)."""
    return df.rollup(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("label") == 1).alias("n_match"),
        F.count_if(F.col("label") == 0).alias("n_non_match"),
        F.count_if(F.col("is_hard_negative") == True).alias("n_hard_neg"),  # noqa: E712
        F.round(F.avg((F.col("label") == 1).cast("double")), 4).alias("match_fraction"))


def leakage(a: DataFrame, b: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row: number of distinct keys present in both."""
    return (a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
            .agg(F.count(F.lit(1)).alias("n_shared")))
