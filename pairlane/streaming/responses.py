"""Streaming form of the append-only negative cache.

Model answers arrive as JSON-lines files in a folder.  The stream parses each
answer (stateless) and appends its items to a sink that keeps every different
answer once: the append runs in ``foreachBatch`` with an anti join against the
sink, so a replayed batch or a repeat, however late, adds nothing and nothing is
dropped by a watermark.  Which answer of a key counts is decided on reading
(``chosen_answers``), so the result does not depend on how files fall into
batches.  The sink is partitioned by a hash bucket of the key; a micro-batch
reads only the buckets that its keys fall into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlane.operators.negatives import explode_items, parsed_items

RESPONSE_SCHEMA = ("pair_id string, kind int, response string, prompt_tokens int, "
                   "completion_tokens int, event_time timestamp")
SINK_SCHEMA = ("cache_key string, pair_id string, product_text string, negative_text string, "
               "neg_idx int, event_time timestamp, key_bucket int")
#: An item of the sink is the same as another if all of these are.
ITEM = ["cache_key", "pair_id", "neg_idx", "negative_text", "event_time"]


def parse_good(responses: DataFrame, text_col: str = "response") -> DataFrame:
    keep = [c for c in responses.columns if c != text_col]
    return explode_items(parsed_items(responses, text_col, keep), keep)


def stream_responses(spark: SparkSession, source_dir: str, products: DataFrame, sink_dir: str,
                     checkpoint_dir: str, files_per_trigger: int = 1, key_buckets: int = 64) -> None:
    """Run the stream to completion over the files present now
    (``availableNow``).  ``products(id_left, pair_id, product_text,
    cache_key)`` is a static table joined in each micro-batch."""
    # an empty append makes the folder, so a first batch reads like any other
    spark.createDataFrame([], SINK_SCHEMA).write.mode("append").partitionBy("key_bucket").parquet(sink_dir)
    src = (spark.readStream.schema(RESPONSE_SCHEMA)
           .option("maxFilesPerTrigger", files_per_trigger).json(source_dir))

    def append(batch: DataFrame, batch_id: int) -> None:
        recs = (batch.withColumnRenamed("pair_id", "id_left").join(products, "id_left")
                .select("cache_key", "pair_id", "product_text", "negative_text",
                        F.col("item_idx").cast("int").alias("neg_idx"), "event_time")
                .withColumn("key_bucket", F.pmod(F.xxhash64("cache_key"), F.lit(key_buckets)).cast("int"))
                .dropDuplicates(ITEM)).persist()
        try:
            buckets = [r[0] for r in recs.select("key_bucket").distinct().collect()]  # <= key_buckets
            # only the sink buckets this batch touches are read (partition pruning)
            have = spark.read.schema(SINK_SCHEMA).parquet(sink_dir).filter(F.col("key_bucket").isin(buckets))
            same = [recs[c].eqNullSafe(have[c]) for c in ITEM]
            if buckets:
                recs.join(have, same, "left_anti").write.mode("append").partitionBy("key_bucket").parquet(sink_dir)
        finally:
            recs.unpersist()

    q = (parse_good(src).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def chosen_answers(spark: SparkSession, sink_dir: str) -> DataFrame:
    """One answer per key: the earliest, of equal times that of the smallest pair
    id; of different texts at one place of it the smallest."""
    sink = spark.read.schema(SINK_SCHEMA).parquet(sink_dir).drop("key_bucket")
    first = sink.groupBy("cache_key").agg(F.min(F.struct("event_time", "pair_id")).alias("_first"))
    return (sink.join(first, "cache_key")
            .filter(F.struct("event_time", "pair_id").eqNullSafe(F.col("_first")))
            .groupBy("cache_key", "pair_id", "product_text", "neg_idx", "event_time")
            .agg(F.min("negative_text").alias("negative_text")))
