"""Registered queries: stratified samples, holdouts, low-resource splits,
split statistics and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.operators import splits as SP
from pairlane.plans.common import pairs, with_pairs
from pairlane.plans.registry import query
from pairlane.schema import SPLIT_FRACTIONS, UNIFIED_COLS
from pairlane.sources.tables import table

GROUPS = ["category"]


def tagged_sql(src: str, out: str, frac: float, seed: int, salt: str, groups: list[str],
               col: str = "label", key: str = "pair_id") -> str:
    """CTEs defining ``out`` = rows of ``src`` plus ``_in`` (in the exact
    stratified sample) and ``_rk`` (rank in class)."""
    g = ", ".join(groups)
    gp = f"PARTITION BY {g}" if groups else ""
    gc = f"{g}, " if groups else ""
    using = ", ".join(groups + [col])
    return f"""
{out}_cls AS (SELECT {gc}{col}, count(*) AS n_c FROM {src} GROUP BY ALL),
{out}_q0 AS (SELECT *, sum(n_c) OVER ({gp}) AS n, ceil(CAST({frac} AS DOUBLE) * sum(n_c) OVER ({gp})) AS n_draw FROM {out}_cls),
{out}_q1 AS (SELECT *, n_c / n * n_draw AS cont, floor(n_c / n * n_draw) AS fl FROM {out}_q0),
{out}_q2 AS (SELECT *, n_draw - sum(fl) OVER ({gp}) AS need,
             row_number() OVER ({gp} ORDER BY cont - fl DESC, {col}) AS rr FROM {out}_q1),
{out}_quota AS (SELECT {gc}{col}, fl + CASE WHEN rr <= need THEN 1 ELSE 0 END AS quota FROM {out}_q2),
{out}_rank AS (SELECT s.*, row_number() OVER (PARTITION BY {gc}{col}
               ORDER BY md5('{seed}|{salt}|' || CAST({key} AS VARCHAR)), {key}) AS _rk FROM {src} s),
{out} AS (SELECT r.*, r._rk <= q.quota AS _in FROM {out}_rank r JOIN {out}_quota q USING ({using}))"""


def _p(spark, sf):
    return pairs(spark, sf).withColumn("category", F.lower("description_left"))


P_SQL = "p AS (SELECT *, lower(description_left) AS category FROM pairs)"
_C = ", ".join(f'"{c}"' for c in UNIFIED_COLS)


@query("stratified_sample", with_pairs(f"SELECT {_C} FROM s WHERE _in",
                                       tagged_sql("pairs", "s", 0.10, 42, "sample", [])))
def _stratified_sample(spark, sf):
    return SP.stratified_sample(pairs(spark, sf), 0.10, 42)


@query("holdout_carve", with_pairs(
    "SELECT pair_id, category, label, CASE WHEN _in THEN 'test' ELSE 'train' END AS split FROM h",
    P_SQL, tagged_sql("p", "h", 0.10, 42, "test", GROUPS)))
def _holdout_carve(spark, sf):
    return SP.holdout_carve(_p(spark, sf), 0.10, 42, groups=GROUPS).select(
        "pair_id", "category", "label", "split")


@query("holdout_reuse", with_pairs(
    "SELECT pair_id, label FROM p WHERE pair_id NOT IN (SELECT pair_id FROM h WHERE _in)",
    P_SQL, tagged_sql("p", "h", 0.10, 42, "test", GROUPS)))
def _holdout_reuse(spark, sf):
    p = _p(spark, sf)
    test = SP.holdout_carve(p, 0.10, 42, groups=GROUPS).filter("split = 'test'")
    return SP.holdout_reuse(p, test).select("pair_id", "label")


@query("train_minus_test", with_pairs(
    f"SELECT {_C} FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h._in AND h.pair_id = p.pair_id)",
    P_SQL, tagged_sql("p", "h", 0.10, 42, "test", GROUPS)))
def _train_minus_test(spark, sf):
    p = _p(spark, sf)
    test = SP.holdout_carve(p, 0.10, 42, groups=GROUPS).filter("split = 'test'").select("pair_id")
    return p.join(test, "pair_id", "left_anti").select(*UNIFIED_COLS)


@query("derive_validation", "WITH " + tagged_sql("labels", "v", 0.10, 42, "val", [], "quality", "doc_id").strip()
       + "\nSELECT doc_id, quality, toxic, CASE WHEN _in THEN 'validation' ELSE 'train' END AS split FROM v")
def _derive_validation(spark, sf):
    lab = table(spark, sf, "labels", "doc_id", "quality", "toxic")
    return SP.derive_validation(lab, 0.10, 42, col="quality", key="doc_id")


def _lrs(spark, sf):
    p = _p(spark, sf)
    v = SP.derive_validation(p, 0.10, 42, groups=GROUPS)
    cols = p.columns
    train0 = v.filter("split = 'train'").select(*cols)
    val = v.filter("split = 'validation'").select(*cols)
    return SP.low_resource_splits(train0, val, None, SPLIT_FRACTIONS, 42, groups=GROUPS)


def _lrs_sql() -> list[str]:
    ctes = [P_SQL, tagged_sql("p", "v", 0.10, 42, "val", GROUPS),
            "t0 AS (SELECT * EXCLUDE (_rk, _in) FROM v WHERE NOT _in)",
            "val AS (SELECT * EXCLUDE (_rk, _in) FROM v WHERE _in)",
            tagged_sql("t0", "h", 0.10, 42, "test", GROUPS),
            "test AS (SELECT * EXCLUDE (_rk, _in) FROM h WHERE _in)",
            "tr AS (SELECT * EXCLUDE (_rk, _in) FROM h WHERE NOT _in)"]
    sel = []
    for name, frac in SPLIT_FRACTIONS.items():
        if frac >= 1.0:
            sel.append(f"SELECT *, 'train_{name}' AS split FROM tr")
        else:
            ctes.append(tagged_sql("tr", f"f{name}", frac, 42, "train", GROUPS))
            sel.append(f"SELECT * EXCLUDE (_rk, _in), 'train_{name}' AS split FROM f{name} WHERE _in")
    sel += ["SELECT *, 'val' AS split FROM val", "SELECT *, 'test' AS split FROM test"]
    ctes.append("lrs AS (" + " UNION ALL ".join(sel) + ")")
    return ctes


@query("low_resource_splits", with_pairs("SELECT split, category, pair_id, label FROM lrs", *_lrs_sql()))
def _low_resource_splits(spark, sf):
    return _lrs(spark, sf).select("split", "category", "pair_id", "label")


_STATS = ("count(*) AS n_pairs, count_if(label = 1) AS n_match, count_if(label = 0) AS n_non_match, "
          "count_if(is_hard_negative) AS n_hard_neg, round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 4) AS match_fraction")


@query("split_stats", with_pairs(f"SELECT category, split, {_STATS} FROM lrs GROUP BY 1, 2", *_lrs_sql()))
def _split_stats(spark, sf):
    return SP.split_stats(_lrs(spark, sf), ["category", "split"])


@query("split_stats_rollup", with_pairs(
    f"SELECT category, split, {_STATS} FROM lrs GROUP BY ROLLUP (category, split)", *_lrs_sql()))
def _split_stats_rollup(spark, sf):
    return SP.split_stats_rollup(_lrs(spark, sf), ["category", "split"])


@query("split_leakage", with_pairs("""
SELECT count(*) AS n_shared FROM (SELECT DISTINCT pair_id FROM lrs WHERE split = 'train_100pct') a
WHERE pair_id IN (SELECT pair_id FROM lrs WHERE split IN ('test', 'val'))""", *_lrs_sql()))
def _split_leakage(spark, sf):
    s = _lrs(spark, sf)
    return SP.leakage(s.filter("split = 'train_100pct'"), s.filter("split IN ('test', 'val')"))


@query("split_counts_check", with_pairs("""
SELECT count(*) AS n_total, count_if(_in) AS n_test, count_if(NOT _in) AS n_train,
 count_if(_in) + count_if(NOT _in) = count(*) AS counts_ok,
 round(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END), 6) AS ratio_all,
 round(sum(CASE WHEN _in AND label = 1 THEN 1.0 ELSE 0.0 END) / count_if(_in), 6) AS ratio_test,
 abs(avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END)
     - sum(CASE WHEN _in AND label = 1 THEN 1.0 ELSE 0.0 END) / count_if(_in)) <= 0.02 AS ratio_ok
FROM h""", P_SQL, tagged_sql("p", "h", 0.10, 42, "test", [])))
def _split_counts_check(spark, sf):
    h = SP.holdout_carve(_p(spark, sf), 0.10, 42).withColumn("_in", F.col("split") == "test")
    m = F.when(F.col("label") == 1, 1.0).otherwise(0.0)
    rt = F.sum(F.when(F.col("_in") & (F.col("label") == 1), 1.0).otherwise(0.0)) / F.count_if("_in")
    return h.agg(F.count(F.lit(1)).alias("n_total"), F.count_if("_in").alias("n_test"),
                 F.count_if(~F.col("_in")).alias("n_train"),
                 (F.count_if("_in") + F.count_if(~F.col("_in")) == F.count(F.lit(1))).alias("counts_ok"),
                 F.round(F.avg(m), 6).alias("ratio_all"), F.round(rt, 6).alias("ratio_test"),
                 (F.abs(F.avg(m) - rt) <= 0.02).alias("ratio_ok"))
