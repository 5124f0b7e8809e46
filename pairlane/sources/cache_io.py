"""Negative cache, failure log and triplet sinks (JSON lines / Parquet
tables partitioned by run keys)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.session import ensure_checkpoint_dir

CACHE_SCHEMA = ("cache_key string, pair_id string, product_text string, negative_text string, "
                "neg_idx int, negative_type string, strategy string, model_id string, "
                "n_negatives_requested int, prompt_tokens bigint, completion_tokens bigint, "
                "timestamp string, _corrupt_record string")
RUN_KEYS = ["model_id", "negative_type", "strategy"]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temp folder)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "pairlane-work", f"{name}-{uuid.uuid4().hex[:12]}")


def append_negative_cache(records: DataFrame, path: str) -> None:
    """Append one JSON line per negative, partitioned by (model, type,
    strategy); Spark escapes '/' in model ids inside partition values."""
    records.write.mode("append").partitionBy(*RUN_KEYS).json(path)


def append_failures(failures: DataFrame, path: str) -> None:
    failures.write.mode("append").json(path)


def append_raw_lines(lines: DataFrame, path: str) -> None:
    """Append raw text lines (used for foreign/malformed lines in tests)."""
    lines.write.mode("append").partitionBy(*RUN_KEYS).text(path)


def load_negative_cache(spark: SparkSession, path: str, neg_type: str | None = None, strategy: str | None = None,
                        model_id: str | None = None) -> DataFrame:
    """Read the JSON-lines cache; malformed lines and lines without a key or text
    are skipped.  The run keys given read only their own partitions."""
    df = (spark.read.schema(CACHE_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    for name, value in (("negative_type", neg_type), ("strategy", strategy), ("model_id", model_id)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return (df.filter(F.col("_corrupt_record").isNull() & F.col("cache_key").isNotNull()
                      & F.col("negative_text").isNotNull()).drop("_corrupt_record"))


def write_triplets(triplets: DataFrame, path: str, category: str, split: str,
                   neg_type: str, strategy: str, model_id: str) -> None:
    (triplets.withColumn("category", F.lit(category)).withColumn("split", F.lit(split))
     .withColumn("negative_type", F.lit(neg_type)).withColumn("strategy", F.lit(strategy))
     .withColumn("model_id", F.lit(model_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("category", "split", "negative_type", "strategy", "model_id").parquet(path))
