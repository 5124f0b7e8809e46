"""Registered queries: pair files in and out."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlane.plans import sqltext as S
from pairlane.plans.common import pairs, with_pairs
from pairlane.plans.registry import query
from pairlane.schema import UNIFIED_COLS
from pairlane.sources import pairs_io as IO
from pairlane.sources.cache_io import work_path

_C = ", ".join(f'"{c}"' for c in UNIFIED_COLS)


def raw_records(spark, sf):
    """Raw dump form of the pair table: match rows carry their ids as
    ``nodeId_*``, labels are strings, the hard flag is written only when
    true (NULL fields are omitted from JSON lines)."""
    p = pairs(spark, sf)
    m = F.col("label") == 1
    cols = []
    for c in UNIFIED_COLS:
        if c in ("id_left", "id_right"):
            cols.append(F.when(~m, F.col(c)).alias(c))
        elif c == "label":
            cols.append(F.col(c).cast("string").alias(c))
        elif c == "is_hard_negative":
            cols.append(F.when(F.col(c), F.lit(True)).alias(c))
        else:
            cols.append(F.col(c))
    cols += [F.when(m, F.col("id_left")).alias("nodeId_left"), F.when(m, F.col("id_right")).alias("nodeId_right")]
    return p.select(*cols)


def _roundtrip(spark, sf):
    path = work_path(spark, "rawpairs")
    raw_records(spark, sf).write.option("compression", "gzip").json(path)
    return IO.read_pairs_json(spark, path)


_RAW_SQL = ", ".join(
    [f"CASE WHEN label = 0 THEN {c} END AS {c}" if c in ("id_left", "id_right")
     else "CAST(label AS VARCHAR) AS label" if c == "label"
     else "CASE WHEN is_hard_negative THEN true END AS is_hard_negative" if c == "is_hard_negative"
     else f'"{c}"' for c in UNIFIED_COLS]
    + ["CASE WHEN label = 1 THEN id_left END AS \"nodeId_left\"",
       "CASE WHEN label = 1 THEN id_right END AS \"nodeId_right\""])


@query("read_pairs_json", with_pairs(f"SELECT {_RAW_SQL} FROM pairs"))
def _read_pairs_json(spark, sf):
    return _roundtrip(spark, sf)


_NORM_SQL = ", ".join(
    [f"coalesce({c}, '') AS {c}" if c.split('_')[0] in ("title", "description", "brand") else
     "coalesce(is_hard_negative, false) AS is_hard_negative" if c == "is_hard_negative" else
     f'"{c}"' for c in UNIFIED_COLS])


@query("normalise_raw_pairs", with_pairs(f"SELECT {_NORM_SQL} FROM pairs"))
def _normalise_raw_pairs(spark, sf):
    return IO.normalise_raw_pairs(_roundtrip(spark, sf))


_CONF_SQL = ", ".join(
    ["id_left || '#' || id_right AS pair_id" if c == "pair_id" else
     "false AS is_hard_negative" if c == "is_hard_negative" else
     f'CAST(NULL AS VARCHAR) AS "{c}"' if c.startswith(("price", "priceCurrency")) else
     f'"{c}"' for c in UNIFIED_COLS])


@query("conform_pairs", with_pairs(f"SELECT {_CONF_SQL} FROM pairs"))
def _conform_pairs(spark, sf):
    """A foreign export without pair ids, hard flags or prices."""
    p = pairs(spark, sf).drop("pair_id", "is_hard_negative", "price_left", "price_right",
                              "priceCurrency_left", "priceCurrency_right")
    return IO.conform_pairs(p)


def _h(salt):
    return F.substring(F.md5(F.concat(F.lit(f"42|{salt}|"), "pair_id")), 1, 1)


def _sh(salt):
    return f"substring(md5('42|{salt}|' || pair_id), 1, 1)"


@query("classify_source", with_pairs(f"""
SELECT split, count(*) AS n_rows FROM (
 SELECT CASE WHEN {_sh('cat')} < '4' THEN 'cameras' ELSE 'computers' END AS cat,
        CASE WHEN {_sh('size')} < '4' THEN 'large' ELSE 'xlarge' END AS size,
        CASE WHEN {_sh('name')} < '4' THEN 'gs' WHEN {_sh('name')} < '8' THEN 'valid_66pair'
             WHEN {_sh('name')} < 'c' THEN 'train' ELSE 'gold_standard' END AS name FROM pairs) t,
 LATERAL (SELECT CASE WHEN name LIKE '%test%' OR name LIKE '%gs%' OR name LIKE '%gold%' THEN 'test'
                      WHEN name LIKE '%valid%' OR name LIKE '%val%' THEN 'validation' ELSE 'train' END AS split)
WHERE cat = 'computers' AND size LIKE '%xlarge%' GROUP BY 1"""))
def _classify_source(spark, sf):
    """Files laid out as cat=<category>/size=<size>/name=<file>/...; accept
    the computers/xlarge files and classify each by its path."""
    p = pairs(spark, sf)
    p = (p.withColumn("cat", F.when(_h("cat") < "4", "cameras").otherwise("computers"))
         .withColumn("size", F.when(_h("size") < "4", "large").otherwise("xlarge"))
         .withColumn("name", F.when(_h("name") < "4", "gs").when(_h("name") < "8", "valid_66pair")
                     .when(_h("name") < "c", "train").otherwise("gold_standard")))
    root = work_path(spark, "sources")
    p.write.partitionBy("cat", "size", "name").option("compression", "gzip").json(root)
    back = IO.with_source(spark.read.schema(", ".join(f"`{c}` string" for c in ["pair_id"])).json(root)
                          .select("pair_id", "_metadata.file_path"), root)
    acc = back.filter(IO.accept_source(F.col("rel_path"), "computers", "xlarge"))
    return acc.groupBy(IO.classify_source(F.regexp_extract("rel_path", r"name=([^/]*)", 1)).alias("split")) \
        .agg(F.count(F.lit(1)).alias("n_rows"))


@query("union_parts", with_pairs(", ".join(
    ["CASE WHEN label = 1 THEN NULL ELSE price_left END AS price_left" if c == "price_left" else
     "CASE WHEN label = 1 THEN NULL ELSE price_right END AS price_right" if c == "price_right" else
     f'"{c}"' for c in UNIFIED_COLS]).join(["SELECT ", " FROM pairs"])))
def _union_parts(spark, sf):
    p = pairs(spark, sf)
    a = p.filter("label = 1").drop("price_left", "price_right")
    b = p.filter("label = 0")
    return IO.union_parts(spark, [a, b])


@query("validate_pairs", with_pairs("""
SELECT count(*) AS n_rows, count_if(label IS NULL) AS n_null_label,
 count_if(label IS NOT NULL AND label NOT IN (0, 1)) AS n_bad_label,
 count_if(label = 1) AS n_match, count_if(label = 0) AS n_non_match, count_if(is_hard_negative) AS n_hard_neg
FROM pairs"""))
def _validate_pairs(spark, sf):
    p = pairs(spark, sf)
    IO.validate_pairs(p)  # raises on bad labels
    return IO.validation_counts(p)


def _lrs_written(spark, sf):
    from pairlane.plans.q_splits import _lrs
    root = work_path(spark, "splits")
    IO.write_splits(_lrs(spark, sf), root)
    return root


def _load_split_sql():
    from pairlane.plans.q_splits import _lrs_sql
    return with_pairs(f"SELECT {_C}, category, split FROM lrs WHERE split = 'train_25pct' AND category = 'small'",
                      *_lrs_sql())


def _load_split(spark, sf):
    root = _lrs_written(spark, sf)
    return IO.load_split(spark, root, "train_25pct", "small").select(*UNIFIED_COLS, "category", "split")


def _write_splits_sql():
    from pairlane.plans.q_splits import _lrs_sql
    return with_pairs("""
SELECT category, split, count(*) AS n_rows, min(pair_id) AS first_pair_id, max(pair_id) AS last_pair_id,
       md5(string_agg(pair_id, ',' ORDER BY pair_id)) AS ids_md5
FROM (SELECT category, split, pair_id FROM lrs WHERE split <> 'train_25pct'
      UNION ALL SELECT category, 'train_25pct', pair_id FROM p
      WHERE NOT EXISTS (SELECT 1 FROM lrs l WHERE l.split IN ('test', 'val') AND l.category = p.category
                        AND l.pair_id = p.pair_id))
GROUP BY 1, 2""", *_lrs_sql())


def _write_splits(spark, sf):
    """Write all splits but one, then, without force, all of them again with every
    pair as the missing one: stored parts stay, and the new one comes without the
    pairs of the stored holdouts."""
    from pairlane.plans.q_splits import _lrs, _p
    from pairlane.sources import split_table
    root = work_path(spark, "splits")
    s = _lrs(spark, sf)
    IO.write_splits(s.filter("split <> 'train_25pct'"), root)
    every = _p(spark, sf).withColumn("split", F.lit("train_25pct")).select(*s.columns)
    IO.write_splits(s.filter("split <> 'train_25pct'").unionByName(every), root)
    parts = split_table.stored_parts(spark, root)
    out = None
    for c, name in sorted(parts):
        part = split_table.read_part(spark, parts, c, name).select("category", "split", "pair_id")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("category", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("pair_id").alias("first_pair_id"), F.max("pair_id").alias("last_pair_id"),
        F.md5(F.array_join(F.sort_array(F.collect_list("pair_id")), ",")).alias("ids_md5"))


query("write_splits", _write_splits_sql())(_write_splits)
query("load_split", _load_split_sql())(_load_split)
