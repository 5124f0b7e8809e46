"""Registered query: the streaming cache writer over replayed answer files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.operators import negatives as N
from pairlane.plans.common import pairs, with_pairs
from pairlane.plans.q_negatives import PARSE_SQL, PROD_SQL
from pairlane.plans.registry import query
from pairlane.sources import fixtures
from pairlane.sources.cache_io import work_path
from pairlane.streaming.responses import chosen_answers, stream_responses


@query("stream_responses", with_pairs("""
SELECT cache_key, pair_id, product_text, neg_idx, negative_text FROM (
 SELECT p.cache_key, p.pair_id, p.product_text, CAST(g.item_idx AS INTEGER) AS neg_idx, g.negative_text,
        dense_rank() OVER (PARTITION BY p.cache_key ORDER BY g.kind, p.pair_id) AS r
 FROM prods p JOIN good g ON g.pair_id = p.id_left) WHERE r = 1""", PARSE_SQL, PROD_SQL))
def _stream_responses(spark, sf, files_per_trigger: int = 1):
    """The response fixture is written as one file per answer kind (a later kind
    has a later time), then the whole folder is replayed a second time (late
    repeats): each key's first answer, once."""
    resp = fixtures.responses(spark, sf).withColumn(
        "event_time", F.timestamp_seconds(F.lit(1767225600) + F.col("kind") * 60))
    src = work_path(spark, "stream-src")
    for rep in range(2):
        for k in range(7):
            resp.filter(F.col("kind") == k).coalesce(1).write.mode("append").json(f"{src}/rep{rep}_kind{k}")
    prods = N.products(pairs(spark, sf), 5).select("id_left", "pair_id", "product_text", "cache_key")
    sink, ckpt = work_path(spark, "stream-sink"), work_path(spark, "stream-ckpt")
    stream_responses(spark, f"{src}/*", prods, sink, ckpt, files_per_trigger)
    return chosen_answers(spark, sink).drop("event_time")
