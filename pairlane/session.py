"""Session helpers: building a local session for tests/bench and reading the
cluster's shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "pairlane") -> SparkSession:
    """A local session for tests and the bench (a cluster passes its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAIRLANE_DRIVER_MEM", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.ansi.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared, reliable location configured by the
    operator; we never override it.  Only when it is unset (tests, a bare
    local session) do we create one.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="pairlane-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared checkpoint folder.

    Used for tables that several later stages read (corpus, query vectors,
    term weights): without it Spark recomputes the shared sub-plan once per
    consumer.  A reliable checkpoint survives executor loss (unlike a local
    checkpoint, which we never use).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reuse(df: DataFrame) -> DataFrame:
    """Keep a deterministic intermediate that several later stages read
    (memory, spilling to disk) and materialise it now.  If an executor is
    lost its blocks are recomputed from lineage, which gives the same rows
    because the plan is deterministic; plans that are not (row tags) use
    ``materialize`` instead."""
    from pyspark import StorageLevel
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df
