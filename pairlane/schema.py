"""Unified product-pair schema (17 columns, fixed order)."""

from __future__ import annotations

from pyspark.sql import types as T

SIDES = ("left", "right")
TEXT_FIELDS = ("id", "title", "description", "brand", "price", "priceCurrency")

# The unified column list, in the order the pipeline stores it.
UNIFIED_COLS = [
    "id_left", "title_left", "description_left", "brand_left",
    "price_left", "priceCurrency_left",
    "id_right", "title_right", "description_right", "brand_right",
    "price_right", "priceCurrency_right",
    "label", "pair_id", "cluster_id_left", "cluster_id_right",
    "is_hard_negative",
]

_TYPES = {"label": T.IntegerType(), "cluster_id_left": T.LongType(),
          "cluster_id_right": T.LongType(), "is_hard_negative": T.BooleanType()}

UNIFIED_SCHEMA = T.StructType([
    T.StructField(c, _TYPES.get(c, T.StringType()), True) for c in UNIFIED_COLS
])

# Raw gzip JSON-lines record: unified names plus the ``nodeId_*`` fallbacks.
RAW_SCHEMA = T.StructType(
    [T.StructField(c, _TYPES.get(c, T.StringType()), True) for c in UNIFIED_COLS
     if c not in ("label",)]
    + [T.StructField("label", T.StringType(), True),
       T.StructField("nodeId_left", T.StringType(), True),
       T.StructField("nodeId_right", T.StringType(), True)]
)

# Split names accepted by load_split.
VALID_SPLITS = ["train_10pct", "train_25pct", "train_100pct", "val", "test"]

# Low-resource training fractions.
SPLIT_FRACTIONS = {"10pct": 0.10, "25pct": 0.25, "100pct": 1.00}

DEFAULT_SEED = 42
