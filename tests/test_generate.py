"""Generation for a split: every type, one run of the generator, failures, re-runs."""

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from pairlane.operators import negatives as N
from pairlane.operators import synth as SY
from pairlane.plans.common import pairs
from pairlane.sources import cache_io

NO_CACHE = ("cache_key string, neg_idx int, negative_text string, negative_type string, strategy string, "
            "model_id string")


@pytest.fixture(scope="module")
def some_pairs(spark):
    return pairs(spark, SF0001).filter("label = 1").orderBy("pair_id").limit(60)


@pytest.mark.parametrize("kind", sorted(SY.GENERATORS))
def test_every_type_generates_or_fails(spark, some_pairs, kind):
    failures = cache_io.work_path(spark, "failures")
    none = spark.createDataFrame([], NO_CACHE)
    out = SY.generate_for_split(some_pairs, none, None, kind, 3, failures_path=failures)
    keys = N.products(some_pairs, 3).select("pair_id", "cache_key")
    done = {r[0] for r in out.join(keys, "pair_id").select("cache_key").distinct().collect()}
    failed = spark.read.schema("pair_id string, error string").json(failures).join(keys, "pair_id")
    failed = {r[0] for r in failed.select("cache_key").distinct().collect()}
    assert not done & failed and done | failed == {r.cache_key for r in keys.collect()}


def test_random_generator_runs_once_and_force_reruns(spark, some_pairs):
    def dice(products, n):
        return products.select("pair_id", F.expr("concat('x', uuid())").alias("negative_text"))
    path = cache_io.work_path(spark, "gen")
    none = spark.createDataFrame([], NO_CACHE)

    def texts(df):
        return {r[0] for r in df.select("negative_text").collect()}
    first = texts(SY.generate_for_split(some_pairs, none, path, "phonetic", 3, generator=dice))
    cache = cache_io.load_negative_cache(spark, path)
    assert first == texts(cache) and first
    again = SY.generate_for_split(some_pairs, cache, path, "phonetic", 3, generator=dice)
    assert texts(again) == first
    forced = texts(SY.generate_for_split(some_pairs, cache, path, "phonetic", 3, force=True, generator=dice))
    cache = cache_io.load_negative_cache(spark, path)
    assert not forced & first and texts(cache) == forced | first
    hits = SY.generate_for_split(some_pairs, cache, path, "phonetic", 3, generator=dice)
    assert texts(hits) == forced | first


def test_unknown_type(spark, some_pairs):
    with pytest.raises(ValueError):
        SY.generate_for_split(some_pairs, spark.createDataFrame([], NO_CACHE), None, "other")


def test_answers_of_another_type_are_no_hits(spark, some_pairs):
    path = cache_io.work_path(spark, "types")
    none = spark.createDataFrame([], NO_CACHE)
    SY.generate_for_split(some_pairs, none, path, "phonetic", 3)
    cache = cache_io.load_negative_cache(spark, path)
    got = SY.generate_for_split(some_pairs, cache, path, "abbreviation", 3)
    fresh = SY.generate_for_split(some_pairs, none, None, "abbreviation", 3)
    cols = ["pair_id", "negative_text", "negative_type"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, fresh.select(*cols).collect()))
    types = cache_io.load_negative_cache(spark, path, "abbreviation", "rules", "rules").select("negative_type").distinct()
    assert [r[0] for r in types.collect()] == ["abbreviation"]


def test_swaps_change_exactly_one_token(spark):
    rows = [("1", "[TITLE] red mug 007oz [BRAND] Acme"), ("2", "[TITLE] blue mug 12oz [BRAND] Acme"),
            ("3", "[TITLE] green cup [BRAND] Bolt"), ("4", "[TITLE] tin mug " + "9" * 20 + " [BRAND] Acme"),
            ("5", "[TITLE] lid " + "1" * 45 + " [BRAND] Acme"), ("6", ""), ("7", None)]
    got = {}
    for r in SY.neg_component_swap(spark.createDataFrame(rows, "pair_id string, product_text string")).collect():
        got.setdefault(r.pair_id, []).append(r.negative_text)
        a, b = r.product_text.split(" "), r.negative_text.split(" ")
        assert len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    assert got["1"] == ["[TITLE] tin mug 007oz [BRAND] Acme", "[TITLE] red mug 012oz [BRAND] Acme"]
    assert got["2"] == ["[TITLE] red mug 12oz [BRAND] Acme", "[TITLE] blue mug 7oz [BRAND] Acme"]
    assert got["4"] == ["[TITLE] blue mug " + "9" * 20 + " [BRAND] Acme"]
    assert not {"3", "5", "6", "7"} & set(got)


def test_successor_of_one_large_class(spark):
    from pairlane.plans.indexing import successor
    df = spark.range(5000).selectExpr("'a' AS k", "id * 3 AS v").unionByName(
        spark.createDataFrame([("b", 7), ("c", 1), ("c", 9), ("c", 9)], "k string, v long")).repartition(5)
    got = {(r.k, r.v): r.n for r in successor(df, "k", "v", "n").collect()}
    assert got == {("a", 3 * i): 3 * ((i + 1) % 5000) for i in range(5000)} | {("c", 1): 9, ("c", 9): 1}
