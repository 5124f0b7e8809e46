"""Duplicated and blank keys."""

from pyspark.sql import functions as F

from pairlane.operators.triplets import triplets_from_negatives
from pairlane.schema import UNIFIED_SCHEMA
from pairlane.sources.pairs_io import normalise_raw_pairs
from pairlane.schema import RAW_SCHEMA


def _pair(i, pid, label=1):
    return (f"L{i}", f"T{i}", "", "B", None, None, f"R{i}", f"U{i}", "", "B", None, None,
            label, pid, None, None, False)


def test_duplicated_pair_id_is_bounded_by_ratio(spark):
    # 50 match rows share one pair id, 10 negatives for it: every row gets
    # exactly `ratio` negatives, the same ones (seeded order is per text)
    pairs = spark.createDataFrame([_pair(i, "HOT") for i in range(50)] + [_pair(99, "P99")], UNIFIED_SCHEMA)
    negs = spark.createDataFrame([("HOT", f"neg {j}") for j in range(10)] + [("P99", "x")],
                                 "pair_id string, negative_text string")
    t = triplets_from_negatives(pairs, negs, ratio=2, seed=42)
    assert t.filter("pair_id = 'HOT'").count() == 100
    assert t.filter("pair_id = 'HOT'").select("negative_text").distinct().count() == 2
    assert t.filter("pair_id = 'P99'").count() == 1


def test_blank_pair_id_is_derived(spark):
    raw = spark.createDataFrame([("a", "b", "", "1"), (None, "d", None, "0")],
                                "id_left string, id_right string, pair_id string, label string")
    for c in RAW_SCHEMA.fieldNames():
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast(RAW_SCHEMA[c].dataType))
    raw = raw.withColumn("nodeId_left", F.when(F.col("id_right") == "d", F.lit("n")))
    out = {r["id_right"]: r["pair_id"] for r in normalise_raw_pairs(raw).collect()}
    assert out == {"b": "a#b", "d": "n#d"}


def test_source_files_prefers_parquet(spark, tmp_path):
    from pairlane.sources.pairs_io import source_files
    root = tmp_path / "hub"
    for rel in ["computers/xlarge/train.json.gz", "computers/xlarge/computers_gs.json.gz",
                "cameras/xlarge/train.json.gz"]:
        f = root / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"")
    got = source_files(spark, str(root), "computers", "xlarge")
    assert [len(got[k]) for k in ("train", "validation", "test")] == [1, 0, 1]
    for rel in ["computers/xlarge/train-0.parquet", "computers/xlarge/valid-0.parquet"]:
        (root / rel).write_bytes(b"")
    got = source_files(spark, str(root), "computers", "xlarge")
    assert all(p.endswith(".parquet") for v in got.values() for p in v)
    assert [len(got[k]) for k in ("train", "validation", "test")] == [1, 1, 0]
