"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.session import ensure_checkpoint_dir

#: Rows per Arrow batch handed to a Python worker: whole texts are long, so a
#: batch stays at some tens of MB even where every text is.
BATCH_ROWS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: it is computed
    once and its lineage ends, so a lost executor costs a read, not a re-run."""
    path = work_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


class Recent:
    """A bounded cache of two generations: what was used since the last turn
    stays when the older half goes."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def turn(self) -> dict:
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        return self.new

    def unknown(self, keys) -> list:
        """Those of ``keys`` that must be computed; older ones come back."""
        out, new, old = [], self.new, self.old
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out
