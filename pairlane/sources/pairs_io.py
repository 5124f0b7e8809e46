"""Pair files: raw JSON lines, conforming to the unified schema, source
classification by path, split storage and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlane.schema import RAW_SCHEMA, UNIFIED_COLS, UNIFIED_SCHEMA, VALID_SPLITS
from pairlane.sources import split_table


def read_pairs_json(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """gzip JSON lines with a fixed raw schema.  Blank lines are skipped; a
    malformed line fails the read (FAILFAST).  A .gz file is one task, so
    the result can be spread with ``min_partitions``."""
    df = spark.read.schema(RAW_SCHEMA).option("mode", "FAILFAST").json(path)
    return df.repartition(min_partitions) if min_partitions else df


def normalise_raw_pairs(raw: DataFrame) -> DataFrame:
    """Raw field names -> unified schema.  ids fall back to ``nodeId_*`` then
    ''; text fields default to ''; price and cluster stay NULL; label
    defaults to 0; the hard flag defaults to false."""
    def s(c, default=""):
        return F.coalesce(F.col(c), F.lit(default))

    cols = {
        "id_left": F.coalesce(F.col("id_left"), F.col("nodeId_left"), F.lit("")),
        "id_right": F.coalesce(F.col("id_right"), F.col("nodeId_right"), F.lit("")),
        "label": F.coalesce(F.col("label").cast("double").cast("int"), F.lit(0)),
        # a blank pair id would make all such rows one key: derive it instead
        "pair_id": F.coalesce(F.nullif(F.col("pair_id"), F.lit("")),
                              F.concat_ws("#", F.coalesce(F.col("id_left"), F.col("nodeId_left"), F.lit("")),
                                          F.coalesce(F.col("id_right"), F.col("nodeId_right"), F.lit("")))),
        "is_hard_negative": F.coalesce(F.col("is_hard_negative"), F.lit(False)),
    }
    for side in ("left", "right"):
        for f in ("title", "description", "brand"):
            cols[f"{f}_{side}"] = s(f"{f}_{side}")
    out = []
    for c, fld in zip(UNIFIED_COLS, UNIFIED_SCHEMA.fields):
        e = cols.get(c, F.col(c))
        out.append(e.cast(fld.dataType).alias(c))
    return raw.select(*out)


def conform_pairs(df: DataFrame) -> DataFrame:
    """Add missing unified columns and project the 17 columns in order.
    ``pair_id`` is derived as ``id_left#id_right`` only when the column is
    missing (or from a row hash when the ids are missing too); the hard flag
    defaults to false; everything else missing is NULL."""
    have = set(df.columns)
    if "pair_id" not in have:
        if {"id_left", "id_right"} <= have:
            df = df.withColumn("pair_id", F.concat_ws("#", F.col("id_left").cast("string"),
                                                      F.col("id_right").cast("string")))
        else:
            df = df.withColumn("pair_id", F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256))
    if "is_hard_negative" not in have:
        df = df.withColumn("is_hard_negative", F.lit(False))
    out = []
    for fld in UNIFIED_SCHEMA.fields:
        if fld.name in df.columns:
            out.append(F.col(fld.name).cast(fld.dataType).alias(fld.name))
        else:
            out.append(F.lit(None).cast(fld.dataType).alias(fld.name))
    return df.select(*out)


def classify_source(rel_path: "F.Column") -> F.Column:
    """test if the path mentions test/gs/gold, validation if valid/val,
    else train."""
    p = F.lower(rel_path)
    return (F.when(p.contains("test") | p.contains("gs") | p.contains("gold"), "test")
            .when(p.contains("valid") | p.contains("val"), "validation")
            .otherwise("train"))


def accept_source(rel_path: "F.Column", category: str, size: str) -> F.Column:
    p = F.lower(rel_path)
    return p.startswith(f"cat={category.lower()}/") & p.contains(size.lower())


def with_source(df: DataFrame, root: str) -> DataFrame:
    """Adds ``rel_path``: the file path of each row below ``root``."""
    fp = F.col("_metadata.file_path")
    rel = F.regexp_replace(fp, r"^.*?" + _re_escape(root.rstrip("/")) + "/", "")
    return df.withColumn("rel_path", rel)


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def union_parts(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """Concatenate the files of one split (columns aligned by name, missing
    ones NULL); no parts -> typed empty frame."""
    if not parts:
        return spark.createDataFrame([], UNIFIED_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return conform_pairs(out)


def write_splits(df: DataFrame, root: str, force: bool = False) -> None:
    """Publish the (category, split) parts of ``df`` (``split_table``): stored parts
    are kept unless ``force``, and no train part keeps a row of a holdout."""
    split_table.write_splits(df, root, force)


def load_split(spark: SparkSession, root: str, split_name: str, category: str) -> DataFrame:
    """Read one published (category, split)."""
    if split_name not in VALID_SPLITS:
        raise ValueError(f"Unknown split '{split_name}'. Choose from: {VALID_SPLITS}")
    return split_table.load_split(spark, root, split_name, category)


def splits_with_stored_test(spark: SparkSession, root: str, train: DataFrame, val: DataFrame,
                            fractions: dict[str, float], seed: int, groups: list[str]) -> DataFrame:
    """Low-resource splits for the table at ``root``: a category whose test part is
    stored keeps it, and its train parts are drawn from what is left of ``train``;
    the others get a test part carved from ``train``."""
    from pairlane.operators.splits import low_resource_splits
    parts = split_table.stored_parts(spark, root)
    held = sorted(c for c, s in parts if s == "test")
    if not held:
        return low_resource_splits(train, val, None, fractions, seed, groups=groups)
    known = F.lower("category").isin(held)
    test = None
    for c in held:
        part = split_table.read_part(spark, parts, c, "test").drop("split")
        test = part if test is None else test.unionByName(part)
    kept = low_resource_splits(train.where(known), val.where(known), test.select(*train.columns), fractions, seed,
                               groups=groups)
    return kept.unionByName(low_resource_splits(train.where(~known), val.where(~known), None, fractions, seed,
                                                groups=groups))


REQUIRED = ("title_left", "title_right", "label")


def validation_counts(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    hard = F.col("is_hard_negative") if "is_hard_negative" in df.columns else F.lit(False)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("label").isNull()).alias("n_null_label"),
        F.count_if(F.col("label").isNotNull() & ~F.col("label").isin(0, 1)).alias("n_bad_label"),
        F.count_if(F.col("label") == 1).alias("n_match"),
        F.count_if(F.col("label") == 0).alias("n_non_match"),
        F.count_if(hard == True).alias("n_hard_neg"))  # noqa: E712


def validate_pairs(df: DataFrame) -> dict:
    """Raise if labels are NULL or not 0/1 (an empty table is allowed)."""
    r = validation_counts(df).first().asDict()
    if r["n_null_label"] or r["n_bad_label"]:
        raise ValueError(f"invalid labels: {r}")
    return r


def source_files(spark: SparkSession, root: str, category: str, size: str) -> dict:
    """List the data files below ``root`` (file metadata only), keep those of
    the category/size, classify each by its path and prefer Parquet: when
    any Parquet file is accepted, ``.json.gz`` files are ignored.
    Returns {split: [paths]}."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    it = fs.listFiles(base, True)
    rels = []
    prefix = fs.makeQualified(base).toString().rstrip("/") + "/"
    while it.hasNext():
        p = it.next().getPath().toString()
        rel = p[len(prefix):] if p.startswith(prefix) else p
        low = rel.lower()
        if (low.endswith(".parquet") or low.endswith(".json.gz")) and \
                low.startswith(f"{category.lower()}/") and size.lower() in low:
            rels.append(rel)
    parquet = [r for r in rels if r.lower().endswith(".parquet")]
    chosen = parquet if parquet else [r for r in rels if r.lower().endswith(".json.gz")]
    out: dict = {"train": [], "validation": [], "test": []}
    for r in sorted(chosen):
        low = r.lower()
        split = ("test" if ("test" in low or "gs" in low or "gold" in low)
                 else "validation" if ("valid" in low or "val" in low) else "train")
        out[split].append(prefix + r)
    return out
