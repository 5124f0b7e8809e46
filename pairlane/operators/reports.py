"""Experiment results log and report selections.

The log has the 17-column run schema (category, split, neg_type,
strategy, llm_model, backbone, ratio, seed, eval_split, acc_at_1,
acc_at_5, mrr, n_train_match, n_hard_neg, training_time_s, eval_time_s,
timestamp).  Reports are filters, unions, windows and unpivots over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("split", T.StringType()),
    T.StructField("neg_type", T.StringType()), T.StructField("strategy", T.StringType()),
    T.StructField("llm_model", T.StringType()), T.StructField("backbone", T.StringType()),
    T.StructField("ratio", T.IntegerType()), T.StructField("seed", T.IntegerType()),
    T.StructField("eval_split", T.StringType()), T.StructField("acc_at_1", T.DoubleType()),
    T.StructField("acc_at_5", T.DoubleType()), T.StructField("mrr", T.DoubleType()),
    T.StructField("n_train_match", T.LongType()), T.StructField("n_hard_neg", T.LongType()),
    T.StructField("training_time_s", T.DoubleType()), T.StructField("eval_time_s", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
])
RESULT_COLS = [f.name for f in RESULT_SCHEMA.fields]
METRICS = ["acc_at_1", "acc_at_5", "mrr"]

# The published ablation design (split, neg_type, strategy,
# llm_model, backbone, ratio, seed, eval_split).
DISTIL = "distilbert-base-uncased"
LLM = "gpt-4o-mini"
RUNS = [
    ("train_10pct", "none", "none", "none", DISTIL, 0, 42, "val"),
    ("train_25pct", "none", "none", "none", DISTIL, 0, 42, "val"),
    ("train_100pct", "none", "none", "none", DISTIL, 0, 42, "val"),
    ("train_10pct", "component_swap", "zero_shot", LLM, DISTIL, 1, 42, "val"),
    ("train_10pct", "component_swap", "few_shot", LLM, DISTIL, 1, 42, "val"),
    ("train_10pct", "component_swap", "chain_of_thought", LLM, DISTIL, 1, 42, "val"),
    ("train_10pct", "phonetic", "chain_of_thought", LLM, DISTIL, 1, 42, "val"),
    ("train_10pct", "abbreviation", "chain_of_thought", LLM, DISTIL, 1, 42, "val"),
    ("train_10pct", "semantic_distractor", "chain_of_thought", LLM, DISTIL, 1, 42, "val"),
    ("train_10pct", "component_swap", "chain_of_thought", LLM, DISTIL, 4, 42, "val"),
    ("train_10pct", "component_swap", "chain_of_thought", LLM, DISTIL, 4, 123, "val"),
    ("train_10pct", "component_swap", "chain_of_thought", LLM, DISTIL, 4, 456, "val"),
    ("train_10pct", "component_swap", "chain_of_thought", LLM, "bert-base-uncased", 1, 42, "val"),
    ("train_10pct", "component_swap", "chain_of_thought", LLM, "msmarco-distilbert-base-v4", 1, 42, "val"),
    ("train_10pct", "component_swap", "chain_of_thought", LLM, DISTIL, 4, 42, "test"),
]
RUN_COLS = ["split", "neg_type", "strategy", "llm_model", "backbone", "ratio", "seed", "eval_split"]

# The in-batch baseline the paper compares against.
PAPER_BASELINE = {"acc_at_1": 0.0433, "acc_at_5": 0.5108, "mrr": 0.2486}

# Experiment factor levels.
LEVELS = {
    "neg_type": ["phonetic", "component_swap", "abbreviation", "semantic_distractor"],
    "strategy": ["zero_shot", "few_shot", "chain_of_thought"],
    "ratio": [1, 4],
    "seed": [42, 123, 456],
}

# Defaults written into rows of older logs that lack a column.
BACKFILL = {"seed": 42, "eval_split": "val", "category": "computers"}


def runs_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RUNS)],
                                 "run int, split string, neg_type string, strategy string, llm_model string, "
                                 "backbone string, ratio int, seed int, eval_split string")


def results_log(ranks: DataFrame, runs: DataFrame) -> DataFrame:
    """ranks(category, run, rank, n_rows) -> one log row per (category, run)."""
    w = F.col("n_rows")
    agg = ranks.groupBy("category", "run").agg(
        F.round(F.sum(F.when(F.col("rank") <= 1, w).otherwise(0)) / F.sum(w), 4).alias("acc_at_1"),
        F.round(F.sum(F.when(F.col("rank") <= 5, w).otherwise(0)) / F.sum(w), 4).alias("acc_at_5"),
        F.round(F.sum(w / F.col("rank")) / F.sum(w), 4).alias("mrr"),
        F.sum(w).cast("bigint").alias("n_train_match"))
    j = agg.join(F.broadcast(runs), "run")  # the run list is a fixed handful of rows
    return j.select(
        "category", *RUN_COLS, "acc_at_1", "acc_at_5", "mrr", "n_train_match",
        (F.col("n_train_match") * F.col("ratio")).cast("bigint").alias("n_hard_neg"),
        F.lit(None).cast("double").alias("training_time_s"), F.lit(None).cast("double").alias("eval_time_s"),
        F.lit(None).cast("string").alias("timestamp"))


def results_append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Align an older log (missing columns) with new rows: union by name,
    backfill the defaults, restore the column order."""
    u = old.unionByName(new, allowMissingColumns=True)
    for c, v in BACKFILL.items():
        u = u.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(RESULT_SCHEMA[c].dataType)))
    return u.select(*RESULT_COLS)


def _sel(log, **eq):
    c = F.lit(True)
    for k, v in eq.items():
        c = c & (F.col(k) == v)
    return log.filter(c)


BASE = dict(split="train_10pct", neg_type="none", seed=42, eval_split="val")


def report_strategy(log: DataFrame) -> DataFrame:
    hn = _sel(log, split="train_10pct", neg_type="component_swap", ratio=1, backbone=DISTIL, seed=42, eval_split="val")
    return hn.unionByName(_sel(log, **BASE)).select("category", "strategy", *METRICS)


def report_type(log: DataFrame) -> DataFrame:
    hn = _sel(log, split="train_10pct", strategy="chain_of_thought", ratio=1, backbone=DISTIL, seed=42, eval_split="val")
    return hn.unionByName(_sel(log, **BASE)).select("category", "neg_type", *METRICS)


def report_ratio(log: DataFrame) -> DataFrame:
    hn = _sel(log, split="train_10pct", neg_type="component_swap", strategy="chain_of_thought",
              backbone=DISTIL, seed=42, eval_split="val")
    return hn.unionByName(_sel(log, **BASE)).select("category", "ratio", *METRICS)


def report_backbone(log: DataFrame) -> DataFrame:
    hn = _sel(log, split="train_10pct", neg_type="component_swap", strategy="chain_of_thought", ratio=1,
              seed=42, eval_split="val")
    return hn.select("category", "backbone", *METRICS)


def report_scaling(log: DataFrame) -> DataFrame:
    """In-batch rows by training size; the smallest size is the reference."""
    b = log.filter((F.col("neg_type") == "none") & (F.col("eval_split") == "val"))
    w = W.partitionBy("category").orderBy("n_train_match", "split")
    ref = F.first("mrr").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return b.select("category", "split", "n_train_match", "mrr",
                    F.round(F.col("mrr") - ref, 4).alias("delta_mrr"))


def report_data_efficiency(log: DataFrame) -> DataFrame:
    """10 % and 25 % in-batch vs the best hard-negative run on 10 %,
    unpivoted to (category, config, metric, value)."""
    b10 = _sel(log, split="train_10pct", neg_type="none", eval_split="val").withColumn("config", F.lit("train_10pct"))
    b25 = _sel(log, split="train_25pct", neg_type="none", eval_split="val").withColumn("config", F.lit("train_25pct"))
    hn = log.filter((F.col("split") == "train_10pct") & (F.col("neg_type") != "none") & (F.col("eval_split") == "val"))
    best = (hn.groupBy("category").agg(F.max_by(F.struct(*METRICS), F.struct("mrr", "neg_type", "strategy", "ratio", "seed", "backbone")).alias("b"))
            .select("category", "b.*").withColumn("config", F.lit("best_hard_negatives")))
    u = b10.select("category", "config", *METRICS).unionByName(b25.select("category", "config", *METRICS)) \
        .unionByName(best.select("category", "config", *METRICS))
    return u.select("category", "config", F.expr(
        "stack(3, 'acc_at_1', acc_at_1, 'acc_at_5', acc_at_5, 'mrr', mrr) AS (metric, value)"))


def report_vs_baseline(log: DataFrame) -> DataFrame:
    return log.select("category", *RUN_COLS, *[
        F.round(F.col(m) - F.lit(v), 4).alias(f"delta_{m}") for m, v in PAPER_BASELINE.items()])


def report_categories(log: DataFrame) -> DataFrame:
    """Baseline vs best hard-negative run per category (self-join on
    category of two one-row-per-category tables)."""
    base = _sel(log, **BASE).select("category", F.col("mrr").alias("baseline_mrr"))
    hn = log.filter((F.col("split") == "train_10pct") & (F.col("neg_type") != "none") & (F.col("eval_split") == "val"))
    best = hn.groupBy("category").agg(F.max("mrr").alias("best_mrr"))
    return base.join(best, "category").withColumn("gain", F.round(F.col("best_mrr") - F.col("baseline_mrr"), 4))


def seed_summary(log: DataFrame) -> DataFrame:
    """mean and sample std over seeds of the repeated configuration."""
    r = _sel(log, split="train_10pct", neg_type="component_swap", strategy="chain_of_thought", ratio=4,
             backbone=DISTIL, eval_split="val")
    aggs = [F.count(F.lit(1)).alias("n_seeds")]
    for m in METRICS:
        aggs += [F.round(F.avg(m), 4).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 4).alias(f"{m}_std")]
    return r.groupBy("category").agg(*aggs)


def experiment_grid(spark, log: DataFrame) -> DataFrame:
    """All factor-level combinations (a literal array exploded, no join)
    minus the configurations already present in the log."""
    import itertools
    keys = list(LEVELS)
    cells = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, combo)])
                      for combo in itertools.product(*LEVELS.values())])
    grid = spark.range(1).select(F.explode(cells).alias("c")).select("c.*")
    done = log.select(*keys).distinct()
    return grid.join(done, keys, "left_anti")
