"""Stratified splits, the published split table and the
published split sizes."""

import pytest
from pyspark.sql import functions as F

from pairlane.operators import splits as SP
from pairlane.schema import SPLIT_FRACTIONS, UNIFIED_SCHEMA


def _make(spark, n_match, n_non):
    rows = []
    for i in range(n_match + n_non):
        rows.append((f"L{i}", f"Product {i} Left", "", "BrandA", None, None,
                     f"R{i}", f"Product {i} Right", "", "BrandA", None, None,
                     1 if i < n_match else 0, f"L{i}#R{i}", None, None, False))
    return spark.createDataFrame(rows, UNIFIED_SCHEMA)


def test_holdout_size_and_ratio(spark):
    train = _make(spark, 100, 500)
    h = SP.holdout_carve(train, 0.10, 42)
    n_test = h.filter("split = 'test'").count()
    n_train = h.filter("split = 'train'").count()
    assert abs(n_test - 60) <= 2 and n_test + n_train == 600
    r = h.filter("split = 'test'").agg(F.avg("label")).first()[0]
    assert abs(r - 100 / 600) <= 0.02


def test_no_leakage_and_nesting(spark):
    train = _make(spark, 100, 500)
    val = _make(spark, 20, 100).withColumn("pair_id", F.concat(F.lit("v"), "pair_id"))
    s = SP.low_resource_splits(train, val, None, SPLIT_FRACTIONS, 42)
    test = s.filter("split = 'test'").select("pair_id")
    for name in ("train_10pct", "train_25pct", "train_100pct"):
        tr = s.filter(F.col("split") == name).select("pair_id")
        assert tr.join(test, "pair_id").count() == 0
    a = {r[0] for r in s.filter("split = 'train_10pct'").select("pair_id").collect()}
    b = {r[0] for r in s.filter("split = 'train_25pct'").select("pair_id").collect()}
    assert a <= b
    assert s.filter("split = 'val'").count() == 120


def test_existing_test_is_reused(spark):
    train = _make(spark, 100, 500)
    test = train.limit(7)
    s = SP.low_resource_splits(train, train.limit(0), test, {"100pct": 1.0}, 42)
    assert s.filter("split = 'train_100pct'").count() == 593


@pytest.mark.parametrize("n,n_match,frac,exp_n,exp_match", [
    (44864, 7934, 0.10, 4487, 794),
    (44864, 7934, 0.25, 11216, 1983),
    (49849, 8816, 0.10, 4985, 882),
    (49291, 6977, 0.10, 4930, 698),
    (49291, 6977, 0.25, 12323, 1744),
    (54768, 7752, 0.10, 5477, 775),
])
def test_published_sizes(spark, n, n_match, frac, exp_n, exp_match):
    df = spark.range(n).select(F.col("id").cast("string").alias("pair_id"),
                               (F.col("id") < n_match).cast("int").alias("label"))
    q = {r["label"]: r["quota"] for r in SP.class_quotas(df, frac).collect()}
    assert q[1] + q[0] == exp_n and q[1] == exp_match


def test_sample_exact_size(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("pair_id"),
                                  (F.col("id") % 7 == 0).cast("int").alias("label"))
    s = SP.stratified_sample(df, 0.1, 42)
    q = {r["label"]: r["quota"] for r in SP.class_quotas(df, 0.1).collect()}
    got = {r["label"]: r["count"] for r in s.groupBy("label").count().collect()}
    assert got == q


def test_null_strata_survive_at_any_number_of_strata(spark):
    from pyspark.sql import functions as F
    from pairlane.operators.splits import rank_in_class
    for groups in (5, 32, 33, 400):
        df = (spark.range(2000).withColumn("pair_id", F.concat(F.lit("p"), F.col("id")))
              .withColumn("g", F.when(F.col("id") % 10 > 0, (F.col("id") % groups).cast("string")))
              .withColumn("label", (F.col("id") % 2).cast("int")))
        out = rank_in_class(df, 1, "t", groups=["g"], fractions={"half": 0.5})
        assert out.count() == 2000
        assert out.where("g IS NULL").count() == 200
        per = out.groupBy("g").agg(F.count("*").alias("n"), F.count_if("half").alias("h")).collect()
        assert all(r.h == -(-r.n // 2) for r in per)


def test_char_wb_counts_short_words_once(spark):
    from pairlane.functions.text import char_wb_ngrams
    df = spark.createDataFrame([("a bc",)], "t string")
    got = sorted(df.select(char_wb_ngrams("t", 2, 4)).first()[0])
    assert got == sorted([" a", "a ", " a ", " b", "bc", "c ", " bc", "bc ", " bc "])


# -- the published split table --------------------------------------------------

def _pairs_table(spark, n=400):
    return spark.createDataFrame([(f"p{i}", i % 4 == 0, int(i % 4 == 0), ["cpu", "tv"][i % 2]) for i in range(n)],
                                 "pair_id string, is_hard_negative boolean, label int, category string")


def _table(spark, root):
    from pairlane.sources import split_table
    parts = split_table.stored_parts(spark, root)
    return {p: {r.pair_id for r in split_table.read_part(spark, parts, *p).collect()} for p in parts}


def _splits_of(spark, root, pairs, fractions, seed):
    from pairlane.sources import pairs_io
    v = SP.derive_validation(pairs, 0.1, 42, groups=["category"])
    cols = pairs.columns
    return pairs_io.splits_with_stored_test(spark, root, v.filter("split = 'train'").select(*cols),
                                            v.filter("split = 'validation'").select(*cols), fractions, seed, ["category"])


def test_stored_test_is_kept_out_of_later_splits(spark, tmp_path):
    from pairlane.sources import pairs_io
    root, pairs = str(tmp_path / "splits"), _pairs_table(spark)
    pairs_io.write_splits(_splits_of(spark, root, pairs, {"10pct": 0.1}, 42), root)
    before = _table(spark, root)
    pairs_io.write_splits(_splits_of(spark, root, pairs, {"10pct": 0.1, "25pct": 0.25}, 7), root)
    after = _table(spark, root)
    assert {p: after[p] for p in before} == before and ("cpu", "train_25pct") in after
    for (c, s), ids in after.items():
        if s.startswith("train"):
            assert not ids & (after[c, "test"] | after[c, "val"])
    # also where the writer did not look at the stored test
    everything = pairs.withColumn("split", F.lit("train_100pct"))
    pairs_io.write_splits(everything, root)
    table = _table(spark, root)
    assert table["tv", "train_100pct"] == {f"p{i}" for i in range(1, 400, 2)} - table["tv", "test"] - table["tv", "val"]


def test_replaced_test_cleans_stored_parts(spark, tmp_path):
    from pairlane.sources import pairs_io
    root, pairs = str(tmp_path / "splits"), _pairs_table(spark, 100)
    pairs_io.write_splits(pairs.withColumn("split", F.lit("train_100pct")), root)
    test = pairs.filter("category = 'tv' AND label = 0").withColumn("split", F.lit("test"))
    pairs_io.write_splits(test, root, force=True)
    table = _table(spark, root)
    assert len(table["tv", "test"]) == 50 and table["tv", "train_100pct"] == set()
    assert len(table["cpu", "train_100pct"]) == 50
    assert pairs_io.load_split(spark, root, "train_100pct", "TV").count() == 0


def test_failed_write_leaves_the_table(spark, tmp_path):
    from pairlane.sources import pairs_io
    root, pairs = str(tmp_path / "splits"), _pairs_table(spark, 40)
    pairs_io.write_splits(pairs.withColumn("split", F.lit("val")), root)
    before = _table(spark, root)
    bad = pairs.withColumn("split", F.lit("test")).withColumn(
        "label", F.expr("CASE WHEN pair_id = 'p7' THEN raise_error('lost') ELSE label END").cast("int"))
    with pytest.raises(Exception):
        pairs_io.write_splits(bad, root, force=True)
    assert _table(spark, root) == before
    with pytest.raises(ValueError):
        pairs_io.write_splits(pairs.withColumn("split", F.lit(None).cast("string")), root)
    with pytest.raises(FileNotFoundError):
        pairs_io.load_split(spark, root, "test", "tv")
    assert _table(spark, str(tmp_path / "nothing")) == {}
