"""Registered queries: results log and experiment reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.operators import reports as RP
from pairlane.operators.triplets import hash60
from pairlane.plans import sqltext as S
from pairlane.plans.common import pairs, with_pairs
from pairlane.plans.evaluate import tfidf_ranks
from pairlane.plans.registry import query
from pairlane.sources.cache_io import work_path

N_RUNS = len(RP.RUNS)


def log_df(spark, sf):
    p = pairs(spark, sf)
    es, _, _, ranks = tfidf_ranks(p)
    cat = p.select(F.col("pair_id").alias("first_pair_id"), F.lower("description_left").alias("category"))
    r = (ranks.join(es.queries.select("query_id", "first_pair_id"), "query_id").join(cat, "first_pair_id")
         .withColumn("run", F.pmod(hash60(F.lit("42|run|"), F.col("first_pair_id")), F.lit(N_RUNS)).cast("int")))
    # one row per (category, run): small, read by several report branches
    from pairlane.session import reuse
    return reuse(RP.results_log(r, RP.runs_table(spark)))


def _v(x):
    return f"'{x}'" if isinstance(x, str) else str(x)


RUNS_SQL = "runs AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join([str(i)] + [_v(x) for x in r]) + ")" for i, r in enumerate(RP.RUNS)) + \
    ") v(run, split, neg_type, strategy, llm_model, backbone, ratio, seed, eval_split))"

LOG_SQL = f"""
rr AS (SELECT lower(p.description_left) AS category,
        CAST(CAST(('0x' || substring(md5('42|run|' || q.first_pair_id), 1, 15)) AS BIGINT) % {N_RUNS} AS INTEGER) AS run,
        r.rank, r.n_rows
       FROM ranks r JOIN queries q USING (query_id) JOIN pairs p ON p.pair_id = q.first_pair_id),
agg AS (SELECT category, run,
         round(sum(CASE WHEN rank <= 1 THEN n_rows ELSE 0 END) / sum(n_rows), 4) AS acc_at_1,
         round(sum(CASE WHEN rank <= 5 THEN n_rows ELSE 0 END) / sum(n_rows), 4) AS acc_at_5,
         round(sum(n_rows / rank) / sum(n_rows), 4) AS mrr, CAST(sum(n_rows) AS BIGINT) AS n_train_match
        FROM rr GROUP BY 1, 2),
log AS (SELECT a.category, u.split, u.neg_type, u.strategy, u.llm_model, u.backbone, CAST(u.ratio AS INTEGER) AS ratio,
         CAST(u.seed AS INTEGER) AS seed, u.eval_split, a.acc_at_1, a.acc_at_5, a.mrr, a.n_train_match,
         CAST(a.n_train_match * u.ratio AS BIGINT) AS n_hard_neg, CAST(NULL AS DOUBLE) AS training_time_s,
         CAST(NULL AS DOUBLE) AS eval_time_s, CAST(NULL AS VARCHAR) AS timestamp
        FROM agg a JOIN runs u USING (run))"""

CTES = [S.tfidf_ctes(), RUNS_SQL, LOG_SQL]


def q(body):
    return with_pairs(body, *CTES)


@query("results_read", q("SELECT * FROM log"))
def _results_read(spark, sf):
    path = work_path(spark, "results")
    log_df(spark, sf).write.option("header", True).csv(path)
    return spark.read.schema(RP.RESULT_SCHEMA).option("header", True).csv(path)


_OLD = "category < 'm'"


@query("results_append", q(f"""
SELECT CASE WHEN {_OLD} THEN 'computers' ELSE category END AS category, split, neg_type, strategy, llm_model,
 backbone, ratio, CASE WHEN {_OLD} THEN 42 ELSE seed END AS seed,
 CASE WHEN {_OLD} THEN 'val' ELSE eval_split END AS eval_split, acc_at_1, acc_at_5, mrr, n_train_match,
 n_hard_neg, training_time_s, eval_time_s, timestamp FROM log"""))
def _results_append(spark, sf):
    """An older log file (no seed / eval_split / category columns) plus new
    rows, read back from CSV and aligned."""
    log = log_df(spark, sf)
    old_path, new_path = work_path(spark, "results-old"), work_path(spark, "results-new")
    log.filter(F.col("category") < "m").drop("seed", "eval_split", "category") \
        .write.option("header", True).csv(old_path)
    log.filter(F.col("category") >= "m").write.option("header", True).csv(new_path)
    old_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RP.RESULT_SCHEMA.fields
                           if f.name not in ("seed", "eval_split", "category"))
    old = spark.read.schema(old_schema).option("header", True).csv(old_path)
    new = spark.read.schema(RP.RESULT_SCHEMA).option("header", True).csv(new_path)
    return RP.results_append(old, new)


@query("results_sorted", q("SELECT * FROM log ORDER BY split, ratio, strategy, neg_type, backbone, category"))
def _results_sorted(spark, sf):
    return log_df(spark, sf).orderBy("split", "ratio", "strategy", "neg_type", "backbone", "category")


_BASE = "split = 'train_10pct' AND neg_type = 'none' AND seed = 42 AND eval_split = 'val'"
_M = "acc_at_1, acc_at_5, mrr"


@query("report_strategy", q(f"""
SELECT category, strategy, {_M} FROM log WHERE split = 'train_10pct' AND neg_type = 'component_swap' AND ratio = 1
 AND backbone = '{RP.DISTIL}' AND seed = 42 AND eval_split = 'val'
UNION ALL SELECT category, strategy, {_M} FROM log WHERE {_BASE}"""))
def _report_strategy(spark, sf):
    return RP.report_strategy(log_df(spark, sf))


@query("report_type", q(f"""
SELECT category, neg_type, {_M} FROM log WHERE split = 'train_10pct' AND strategy = 'chain_of_thought' AND ratio = 1
 AND backbone = '{RP.DISTIL}' AND seed = 42 AND eval_split = 'val'
UNION ALL SELECT category, neg_type, {_M} FROM log WHERE {_BASE}"""))
def _report_type(spark, sf):
    return RP.report_type(log_df(spark, sf))


@query("report_ratio", q(f"""
SELECT category, ratio, {_M} FROM log WHERE split = 'train_10pct' AND neg_type = 'component_swap'
 AND strategy = 'chain_of_thought' AND backbone = '{RP.DISTIL}' AND seed = 42 AND eval_split = 'val'
UNION ALL SELECT category, ratio, {_M} FROM log WHERE {_BASE}"""))
def _report_ratio(spark, sf):
    return RP.report_ratio(log_df(spark, sf))


@query("report_backbone", q(f"""
SELECT category, backbone, {_M} FROM log WHERE split = 'train_10pct' AND neg_type = 'component_swap'
 AND strategy = 'chain_of_thought' AND ratio = 1 AND seed = 42 AND eval_split = 'val'"""))
def _report_backbone(spark, sf):
    return RP.report_backbone(log_df(spark, sf))


@query("report_scaling", q("""
SELECT category, split, n_train_match, mrr,
 round(mrr - first_value(mrr) OVER (PARTITION BY category ORDER BY n_train_match, split
       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS delta_mrr
FROM log WHERE neg_type = 'none' AND eval_split = 'val'"""))
def _report_scaling(spark, sf):
    return RP.report_scaling(log_df(spark, sf))


@query("report_data_efficiency", q(f"""
SELECT category, config, metric, value FROM (
 SELECT category, 'train_10pct' AS config, {_M} FROM log WHERE split = 'train_10pct' AND neg_type = 'none' AND eval_split = 'val'
 UNION ALL SELECT category, 'train_25pct', {_M} FROM log WHERE split = 'train_25pct' AND neg_type = 'none' AND eval_split = 'val'
 UNION ALL SELECT category, 'best_hard_negatives', b.acc_at_1, b.acc_at_5, b.mrr FROM (
   SELECT category, arg_max(struct_pack(acc_at_1 := acc_at_1, acc_at_5 := acc_at_5, mrr := mrr),
          struct_pack(mrr := mrr, neg_type := neg_type, strategy := strategy, ratio := ratio, seed := seed, backbone := backbone)) AS b
   FROM log WHERE split = 'train_10pct' AND neg_type <> 'none' AND eval_split = 'val' GROUP BY 1))
UNPIVOT (value FOR metric IN (acc_at_1, acc_at_5, mrr))"""))
def _report_data_efficiency(spark, sf):
    return RP.report_data_efficiency(log_df(spark, sf))


@query("report_vs_baseline", q("SELECT category, split, neg_type, strategy, llm_model, backbone, ratio, seed, eval_split, "
                               + ", ".join(f"round({m} - {v}, 4) AS delta_{m}" for m, v in RP.PAPER_BASELINE.items())
                               + " FROM log"))
def _report_vs_baseline(spark, sf):
    return RP.report_vs_baseline(log_df(spark, sf))


@query("report_categories", q(f"""
SELECT b.category, b.mrr AS baseline_mrr, h.best_mrr, round(h.best_mrr - b.mrr, 4) AS gain
FROM (SELECT category, mrr FROM log WHERE {_BASE}) b
JOIN (SELECT category, max(mrr) AS best_mrr FROM log WHERE split = 'train_10pct' AND neg_type <> 'none'
      AND eval_split = 'val' GROUP BY 1) h USING (category)"""))
def _report_categories(spark, sf):
    return RP.report_categories(log_df(spark, sf))


@query("seed_summary", q(f"""
SELECT category, count(*) AS n_seeds, """ + ", ".join(
    f"round(avg({m}), 4) AS {m}_mean, round(stddev_samp({m}), 4) AS {m}_std" for m in RP.METRICS) + f"""
FROM log WHERE split = 'train_10pct' AND neg_type = 'component_swap' AND strategy = 'chain_of_thought' AND ratio = 4
 AND backbone = '{RP.DISTIL}' AND eval_split = 'val' GROUP BY 1"""))
def _seed_summary(spark, sf):
    return RP.seed_summary(log_df(spark, sf))


def _grid_sql():
    import itertools
    keys = list(RP.LEVELS)
    rows = ", ".join("(" + ", ".join(_v(x) for x in combo) + ")" for combo in itertools.product(*RP.LEVELS.values()))
    return (f"SELECT * FROM (VALUES {rows}) g({', '.join(keys)}) "
            f"WHERE ({', '.join(keys)}) NOT IN (SELECT ({', '.join(keys)}) FROM log)")


@query("experiment_grid", q(_grid_sql()))
def _experiment_grid(spark, sf):
    return RP.experiment_grid(spark, log_df(spark, sf))
