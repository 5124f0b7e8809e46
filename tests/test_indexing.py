"""dense_index equals a global row_number; split strata paths agree."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlane.operators import splits as SP
from pairlane.plans import indexing


def test_dense_index_both_paths(spark, monkeypatch):
    df = spark.range(0, 20000, 1, 4).select((F.col("id") * 7919 % 20011).alias("k"))
    for lim in (64, 1):  # literal offsets / broadcast-joined offsets
        monkeypatch.setattr(indexing, "MAX_LITERAL_KEYS", lim)
        r = indexing.dense_index(df.repartition(37), ["k"], "i")
        ref = r.withColumn("ref", F.row_number().over(W.orderBy("k")) - 1)
        assert ref.filter("i <> ref").count() == 0
        assert r.count() == 20000


def test_split_strata_paths_agree(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").cast("string").alias("pair_id"),
                                  (F.col("id") % 5 == 0).cast("int").alias("label"),
                                  (F.col("id") % 3).cast("string").alias("category"))
    a = {r[0] for r in SP.stratified_sample(df, 0.1, 42, groups=["category"]).select("pair_id").collect()}
    monkeypatch.setattr(SP, "MAX_LITERAL_STRATA", 1)
    b = {r[0] for r in SP.stratified_sample(df, 0.1, 42, groups=["category"]).select("pair_id").collect()}
    assert a == b and len(a) == sum(
        r["quota"] for r in SP.class_quotas(df, 0.1, groups=["category"]).collect())
